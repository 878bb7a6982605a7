"""Text of the derived ledger pages in plain Python, run by Arrow batches inside Spark's tasks.

Null and negative numbers give what the SQL functions of the same steps give: remainders have
the sign of the dividend, parts without a value are left out where parts are joined.
"""

from __future__ import annotations

KINDS = "IPDX"
#: Days whose text is kept at a time.
DAYS = 10_000


def rem(a: int, b: int) -> int:
    """Remainder with the sign of the dividend."""
    return a % b if a >= 0 else -(-a % b)


def day_text(day: int) -> str:
    """``MM/dd/yyyy`` of a day since 1970, in the Gregorian calendar of any year."""
    era, of_era = divmod(day + 719_468, 146_097)
    year = (of_era - of_era // 1460 + of_era // 36_524 - of_era // 146_096) // 365
    of_year = of_era - (365 * year + year // 4 - year // 100)
    march = (5 * of_year + 2) // 153
    month = march + 3 if march < 10 else march - 9
    year += era * 400 + (month <= 2)
    sign = "+" if year > 9999 else "-" if year < 0 else ""
    return f"{month:02d}/{of_year - (153 * march + 2) // 5 + 1:02d}/{sign}{abs(year):04d}"


class Days(dict):
    """Texts of days, made when first asked for."""

    def __missing__(self, day: int) -> str:
        if len(self) >= DAYS:
            self.clear()
        text = self[day] = day_text(day)
        return text


def plain_amount(cents: int) -> str:
    if cents >= 0:
        return f"{cents // 100}.{cents % 100:02d}"
    units = str(-(-cents // 100)) if cents <= -100 else "0"
    return f"{units}.{str(rem(cents, 100)).rjust(2, '0')[:2]}"


def _invoice(key: int, customer: int, i: int) -> str | None:
    """An invoice line, a footer phrase before some; None without a type."""
    kind = rem(key + i, 4)
    if kind < 0:
        return None
    number = 100_000 + key * 13 + rem(i * 7, 11)
    if i % 3 == 1 and i >= 0:
        line = f"{number} PO{customer}A{i} {KINDS[kind]}"
    else:
        label = "CK" if i >= 0 and i % 6 == 5 else "PO"
        line = f"{number} {KINDS[kind]} *{label}#: PO{customer}A{i}"
    return f"STRIVING TO EARN your trust\n{line}" if i == 2 and key % 9 == 0 else line


def ledger_page(
    key: int | None, customer: int | None, day: int | None, cents: int | None, days: Days
) -> str | None:
    """The page of an order; without a customer there is none, without other values no such parts."""
    if customer is None:
        return None
    n = rem(customer, 12)
    every = range(n + 1) if n >= 0 else range(0, n - 1, -1)
    lines = ["# Account Statement", "Invoice No Type Reference"]
    if key is not None:
        lines += [line for i in every if (line := _invoice(key, customer, i)) is not None]
    lines += ["", "| Invoice Date | Due Date | Amount |", "|---|---|---|"]
    last: list[str] = []
    if day is not None and cents is not None:
        lines += [
            f"| {days[day + i]} | {days[day + i + 30]} | {plain_amount(cents + i * 1001)} |" for i in every
        ]
    else:
        for i in every:
            cells = [days[day + i], days[day + i + 30]] if day is not None else []
            cells += [plain_amount(cents + i * 1001)] if cents is not None else []
            lines.append(f"| {' | '.join(cells)} |")
    if day is not None:
        last += [days[day], days[day + 30], days[day + 1], days[day + 31]]
    if cents is not None:
        last += [plain_amount(cents + i * 1001) for i in range(3)]
    lines += [f"| {' | '.join(last)} |", "Thank you"]
    if key is not None and key % 5 == 0:
        lines += ["Invoice No | Type | Reference", "77001 I", "88002 D late"]
    return "\n".join(lines)
