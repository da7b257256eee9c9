"""Row builders shared by the tests."""


def tx_rows(user, *rows):
    """Rows given as (date, overrides); everything else is an ordinary monthly renewal."""
    out = []
    for day, over in rows:
        base = {
            "method": 41,
            "plan": 30,
            "price": 149,
            "paid": 149,
            "renew": 1,
            "expire": 20170228,
            "cancel": 0,
        }
        base.update(over)
        out.append(
            (
                user,
                base["method"],
                base["plan"],
                base["price"],
                base["paid"],
                base["renew"],
                day,
                base["expire"],
                base["cancel"],
            )
        )
    return out
