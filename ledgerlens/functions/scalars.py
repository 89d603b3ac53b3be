"""Column expressions over single fields: flags, casts, cards, times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings of no.
FALSEY = ("", "0", "false", "f", "no", "n", "none", "null", "nan")


def truthy(flag: Column) -> Column:
    """A flag in any type as 0/1; null is 0."""
    text = F.lower(F.trim(flag.cast("string"), F.lit(" \t\n\r\x0b\x0c")))
    return F.when(flag.isNull() | text.isin(*FALSEY), 0).otherwise(1)


def number_or(value: Column, default: float) -> Column:
    """A double, or the default where the text is none."""
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))


def whole_or_zero(value: Column) -> Column:
    """A whole number cut towards zero, or 0."""
    number = value.try_cast("double")
    whole = F.when(F.abs(number) < 9e18, number.cast("bigint"))
    return F.coalesce(value.try_cast("bigint"), whole, F.lit(0).cast("bigint"))


def stamp_or_epoch(seconds: Column) -> Column:
    """Epoch seconds to a timestamp. Nulls and other texts go to 1970, where nobody takes them for a real time."""
    number = seconds.try_cast("double")
    return F.timestamp_micros(F.coalesce(F.round(number * 1e6).cast("bigint"), F.lit(0)))


def tiyin(amount: Column) -> Column:
    """An amount in hundredths, so that sums over windows stay exact."""
    return F.bround(amount * 100).cast("bigint")


def mask_card(card: Column) -> Column:
    """Six leading and four last digits of a card number, the middle starred out. Below twelve characters there is nothing to hide."""
    return (F.when(F.length(card) >= 12,
                   F.concat(F.substring(card, 1, 4), F.lit(" "), F.substring(card, 5, 2),
                            F.lit("** **** "), F.right(card, F.lit(4))))
            .otherwise(F.coalesce(card, F.lit(""))))


def card_matches(card: Column, digits: str) -> Column:
    """Digits against a whole card, its first six or its last four."""
    card = F.coalesce(card, F.lit(""))
    match = card == digits
    if len(digits) <= 6:
        match |= card.startswith(digits)
    if len(digits) <= 4:
        match |= card.endswith(digits)
    return match


# Card network -> leading digits.
NETWORKS = {"UzCard": "8600", "HUMO": "9860"}


def card_network(card: Column) -> Column:
    """The network named by a card's leading digits; null for an unknown one, to be rejected."""
    name = F.lit(None).cast("string")
    for network, prefix in NETWORKS.items():
        name = F.when(card.startswith(prefix), network).otherwise(name)
    return name


# Hour of the day in UTC from `event_us`, whatever the session's zone.
HOUR_SQL = "cast(floor(pmod(event_us, 86400000000) / 3600000000) as double)"


def span_ms(start_us: Column, end_us: Column) -> Column:
    """Milliseconds between two stamps, null when one is missing."""
    return (end_us - start_us) / 1000.0


def spread(ident: Column, buckets: int) -> Column:
    """An id's bucket out of `buckets`, evenly and always the same."""
    number = F.conv(F.substring(F.md5(ident.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return (number % buckets).cast("int")
