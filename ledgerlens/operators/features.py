"""The 28 behavioural features of each transfer, from everything processed before it.

Rows count as processed in the order (event_us, transaction_id). Two timelines carry all of it:
the payee account's (who pays it, how much, its contacts) and the sender account's (its own
transfers, what it was last paid). On each, a transfer is an entry and every window it belongs to
has a closing entry, so that a feature is a running sum (see `timeline`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import settings as S
from ..functions import geo, scalars
from ..profile import FULL, Profile
from .confirmed import contact_pieces
from ..sources.files import stored
from .timeline import Max, Min, Moments, Next, Sum, rows_per_slice, running, slices_for

US = S.SECOND_US
PLACE = ["at", "rank", "id", "half"]      # an entry's place in its account's timeline
TIME, TRANSFER = 0, 1                     # rank: what the clock does comes before what people do
OUT, IN, AFTER = 0, 1, 2                  # half: a transfer is read by its sender, its payee, then filed
# kind: a transfer, the ends of its windows, an account's flag, a contact, money received
BEGIN, END_10M, END_1H, END_24H, END_7D, FLAG, CONTACT, PAID = range(8)
SPAN = {END_10M: S.TEN_MINUTES, END_1H: S.HOUR, END_24H: S.DAY, END_7D: S.WEEK}
ORDER = ["event_us", "transaction_id"]

FEATURES = FULL.feature_names
HELPERS = ["travel_kmh", "travel_distance_km", "has_history", "amount_gt_factor_mean"]

# What each part of the plan is for; a part that nobody asks for is left out.
PAYERS = {"rcv_distinct_senders_1h", "payee_payers_24h", "payee_payers_7d", "payee_new_payers_24h"}
PAYEE_FLAGS = {"payee_flagged", "payee_flagged_contacts"}
PAYEE_SIDE = PAYERS | PAYEE_FLAGS | {"rcv_inflow_1h", "payee_inflow_24h"}
PAIRS = {"is_new_payee", "distinct_payees_10m", "sender_payees_24h", "sender_payees_7d", "sender_new_payees_24h",
         "sender_new_payee_sum_24h"}
PAYEE_ENDS = {END_1H: {"rcv_distinct_senders_1h", "rcv_inflow_1h"},
              END_24H: {"payee_inflow_24h", "payee_payers_24h", "payee_new_payers_24h"}, END_7D: {"payee_payers_7d"}}
SENDER_ENDS = {END_10M: {"vel_10m", "distinct_payees_10m"}, END_1H: {"vel_1h", "sub_threshold_1h"},
               END_24H: {"daily_sum_ratio", "sender_payees_24h", "sender_new_payees_24h", "sender_new_payee_sum_24h"},
               END_7D: {"sender_payees_7d"}}
#: What a plan of chosen features reads of a transfer.
READ = ["transaction_id", "event_us", "sender_key", "payee_key", "payer_id", "amount", "amount_tiyin", "secs_login", "sender_region",
        "active_call"]


@dataclass(frozen=True)
class Census:
    """What one aggregated pass says about the input: its last moment, and whether an account has
    more rows than a task should hold, as payee or in any role."""
    horizon: int
    heavy_payee: bool
    heavy_account: bool

    @staticmethod
    def of(transfers: DataFrame) -> "Census":
        role = "inline(array(struct(0 role, payee_key k), struct(1 role, payee_key k), struct(1 role, sender_key k)))"
        seen = (transfers.select("event_us", F.expr(role)).groupBy("role", "k")
                .agg(F.count(F.lit(1)).alias("n"), F.max("event_us").alias("last"))
                .agg(F.expr("max(if(role = 0, n, 0))"), F.expr("max(if(role = 1, n, 0))"), F.max("last"))
                .first())
        limit = rows_per_slice(transfers.sparkSession)
        return Census(seen[2] or 0, (seen[0] or 0) > limit, (seen[1] or 0) > limit)


@dataclass(frozen=True)
class Prior:
    """What transfers before a moment add up to, when the input begins there. `senders`: account,
    hist_* and login_* (n, sum, m2, low, high), last_sent, last_place; `regions`: sender_key,
    region_here, region_count, region_first; `pairs`: payee_key, sender_key, last; `payers`:
    payee_key, payer_id, last."""
    senders: DataFrame
    regions: DataFrame
    pairs: DataFrame
    payers: DataFrame


def _entries(rows: DataFrame, key: str, half: int, ends: list[int], horizon: int,
             keep: list[str], unread: set[str]) -> DataFrame:
    """A transfer's own entry and the ends of its windows, up to the last transfer. The transfer
    itself stays on its own entry, without its `unread` columns; the others have what they take back.
    A week's end is needed only where the pair does not meet again before it."""
    parts = [f"struct({BEGIN} kind, event_us at, {TRANSFER} rank, transaction_id id, {half} half)"]
    for kind in ends:
        end = f"struct({kind} kind, event_us + {SPAN[kind] * US + 1} at, {TIME} rank, '' id, {OUT} half)"
        parts.append(f"if(next_gap <= {S.WEEK * US}, null, {end})" if kind == END_7D else end)
    payload = ", ".join(f"`{c}`" for c in rows.columns if c not in unread)
    out = rows.select(
        F.col(key).alias("account"), F.expr(f"struct({payload})").alias("transfer"), *keep,
        F.expr(f"inline(filter(array({', '.join(parts)}), e -> e.at <= {horizon}))"))
    return out.withColumn("transfer", F.expr(f"if(kind = {BEGIN}, transfer, null)"))


def _window_sum(value: str, end: int) -> Sum:
    """Sum over a sliding window: added by the transfer, taken back at the window's end."""
    return Sum(F.expr(f"case kind when {BEGIN} then {value} when {end} then -({value}) end"))


def _window_distinct(end: int) -> Sum:
    """Distinct counterparties in a sliding window: one more when the pair was not inside it, one
    less when it does not meet again before the window ends."""
    span = SPAN[end] * US
    return Sum(F.expr(f"case kind when {BEGIN} then if(prev_gap <= {span}, 0, 1) "
                      f"when {end} then if(next_gap <= {span}, 0, -1) end"))


def _steps(kind: int) -> Sum:
    return Sum(F.expr(f"if(kind = {kind}, step, 0)"))


def _with_marks(rows: DataFrame, marks: DataFrame, by: str, heavy: bool) -> DataFrame:
    """`rows` and what is known from before them, told apart by `_known`. Marks go to the tasks that hold their account's rows, so
    that the rows are not shuffled for them."""
    marks = marks if heavy else marks.repartition(by)
    return rows.withColumn("_known", F.lit(False)).unionByName(marks.withColumn("_known", F.lit(True)), allowMissingColumns=True)


def pair_times(rows: DataFrame, pair: list[str], prefix: str, slices: int, prior: DataFrame | None = None, heavy: bool = False) -> DataFrame:
    """How long ago the same pair last met and how long until it meets next, and how long ago it met, earlier than the input too: a
    prior pair stands before its transfers with the moment it last met."""
    met = F.col("event_us")
    measures = {f"{prefix}_prev": Max(met, before=True), f"{prefix}_next": Next(met)}
    if prior is not None:
        rows = _with_marks(rows, prior.select(*pair, F.col("last").alias("event_us")), pair[0], heavy)
        measures |= {f"{prefix}_prev": Max(F.expr("if(_known, null, event_us)"), before=True), f"{prefix}_ever": Max(met, before=True)}
    rows = running(stored(rows) if slices else rows, pair, ORDER, measures, slices)
    if prior is not None:
        rows = rows.filter("not _known").drop("_known")
    ever = f"{prefix}_ever" if prior is not None else f"{prefix}_prev"
    return rows.withColumns({f"{prefix}_prev": F.expr(f"event_us - {prefix}_prev"),
                             f"{prefix}_next": F.expr(f"{prefix}_next - event_us"),
                             f"{prefix}_ever": F.expr(f"event_us - {ever}")})


def flag_marks(confirmed: DataFrame, horizon: int) -> DataFrame:
    """Entries that switch an account's flag on and off again."""
    mark = lambda at, step: (f"if({at} is null, null, struct({FLAG} kind, {at} at, {TIME} rank, '' id, "
                             f"{OUT} half, {step} step))")
    return confirmed.filter("account <> ''").select("account", F.expr(
        f"inline(filter(array({mark('from_us', 1)}, {mark('to_us', -1)}), e -> e.at <= {horizon}))"))


def contact_marks(rows: DataFrame, confirmed: DataFrame, census: Census) -> DataFrame:
    """+1 and -1 around every stretch in which a confirmed account is a contact of the week."""
    pieces = contact_pieces(rows, confirmed, census.heavy_account).filter(
        "struct(from_at, from_rank, from_id) < struct(to_at, to_rank, to_id)")
    side = lambda s, step: (f"struct({CONTACT} kind, {s}_at at, {s}_rank rank, {s}_id id, {AFTER} half, "
                            f"{step} step)")
    return pieces.select("account", F.expr(
        f"inline(filter(array({side('from', 1)}, {side('to', -1)}), e -> e.at <= {census.horizon}))"))


def with_pair_times(rows: DataFrame, heavy: bool, prior: Prior | None) -> DataFrame:
    """When sender and payee met last and meet next, for the sender's side."""
    pair = ["payee_key", "sender_key"]
    return pair_times(rows, pair, "pair", slices_for(rows, pair) if heavy else 0, prior and prior.pairs, heavy)


def with_payee_features(rows: DataFrame, confirmed: DataFrame | None, census: Census, prior: Prior | None,
                        wanted: set[str], unread: set[str]) -> DataFrame:
    """Fan-in, inflow, new payers, flags and contacts of the paid account, and the pair times of
    sender and payee that the sender's side needs."""
    heavy = census.heavy_payee
    base = rows
    cut = lambda r, key: slices_for(r, key) if heavy else 0
    if not heavy:
        rows = rows.repartition("payee_key")
    if wanted & PAIRS:
        rows = with_pair_times(rows, heavy, prior)
    payer = ["payee_key", "payer_id"]
    if wanted & PAYERS:
        rows = pair_times(rows, payer, "payer", cut(base, payer), prior and prior.payers, heavy)
    else:
        rows = rows.withColumns({f"payer_{c}": F.lit(None).cast("bigint") for c in ("prev", "next", "ever")})
    new = F.expr(f"if(payer_ever <= {S.MONTH * US}, 0, 1)").alias("new")
    rows = rows.withColumnsRenamed({"payer_prev": "prev_gap", "payer_next": "next_gap"})
    keep = [F.col("amount_tiyin").alias("money"), "prev_gap", "next_gap", new]
    line = _entries(rows, "payee_key", IN, [e for e, of in PAYEE_ENDS.items() if of & wanted], census.horizon, keep,
                    unread | {"prev_gap", "next_gap", "payer_ever"})
    if confirmed is not None and wanted & PAYEE_FLAGS:
        marks = flag_marks(confirmed, census.horizon)
        if "payee_flagged_contacts" in wanted:
            marks = marks.unionByName(contact_marks(base, confirmed, census))
        line = line.unionByName(marks if heavy else marks.repartition("account"),
                                allowMissingColumns=True)
    else:
        line = line.withColumn("step", F.lit(0))
    line = running(line, ["account"], PLACE, {
        "run_in_1h": _window_sum("money", END_1H), "run_in_24h": _window_sum("money", END_24H),
        "run_payers_1h": _window_distinct(END_1H), "run_payers_24h": _window_distinct(END_24H),
        "run_payers_7d": _window_distinct(END_7D), "run_new": _window_sum("new", END_24H),
        "run_flagged": _steps(FLAG), "run_contacts": _steps(CONTACT)},
        None if heavy else 0)
    return line.filter("transfer is not null").selectExpr(
        "transfer.*", *[f"{e} {n}" for n, e in payee_columns().items() if n in wanted])


def payee_columns() -> dict[str, str]:
    """Feature -> SQL over the paid account's running measures; a transfer without a payee key has no payee's side to read."""
    seen = lambda step: f"if(account <> '', run_{step}, 0)"
    return {"rcv_distinct_senders_1h": seen("payers_1h"), "rcv_inflow_1h": f"log1p({seen('in_1h')} / 100D)",
            "payee_inflow_24h": f"log1p({seen('in_24h')} / 100D)", "payee_payers_24h": seen("payers_24h"),
            "payee_payers_7d": seen("payers_7d"), "payee_new_payers_24h": seen("new"),
            "payee_flagged": f"cast({seen('flagged')} > 0 as int)", "payee_flagged_contacts": seen("contacts")}


def with_sender_features(rows: DataFrame, credits: DataFrame, confirmed: DataFrame | None,
                         census: Census, prior: Prior | None, wanted: set[str], unread: set[str]) -> DataFrame:
    """The sender's own habits, windows, flags and journey, and when it was last paid.

    `rows` carry the pair times; `credits` are all transfers again, by payee.
    """
    heavy = census.heavy_account
    cut = lambda r, key: slices_for(r, key) if heavy else 0
    if not heavy:
        rows = rows.repartition("sender_key")
    if not wanted & PAIRS:
        rows = rows.withColumns({f"pair_{c}": F.lit(None).cast("bigint") for c in ("prev", "next", "ever")})
    elif "pair_prev" not in rows.columns:
        rows = with_pair_times(rows, heavy, prior)
    rows = rows.withColumn("region_here", F.expr("coalesce(sender_region, '')"))
    home_key = ["sender_key", "region_here"]
    if "geo_is_anomaly" in wanted:
        slices = cut(credits.selectExpr("sender_key", "coalesce(sender_region, '') region_here"), home_key)
        count, first = F.lit(1), F.struct("event_us", "transaction_id")
        if prior is not None:
            marks = prior.regions.select(*home_key, F.col("region_count").alias("_n"), F.col("region_first").alias("_first"))
            rows = _with_marks(rows, marks, "sender_key", heavy)
            count, first = F.expr("if(_known, _n, 1)"), F.expr("if(_known, _first, struct(event_us, transaction_id))")
        rows = running(stored(rows) if slices else rows, home_key, ORDER,
                       {"region_count": Sum(count), "region_first": Min(first)}, slices)
        if prior is not None:
            rows = rows.filter("not _known").drop("_known", "_n", "_first")
    else:
        rows = rows.withColumns({"region_count": F.lit(0).cast("bigint"), "region_first": F.struct("event_us", "transaction_id")})
    rows = rows.withColumnsRenamed({"pair_prev": "prev_gap", "pair_next": "next_gap"})
    low, high = S.STRUCTURING_BAND_LOW * S.STRUCTURING_THRESHOLD, S.STRUCTURING_THRESHOLD
    keep = [F.col("amount_tiyin").alias("money"), "prev_gap", "next_gap",
            F.expr("if(pair_ever is null, 1, 0)").alias("new"), F.expr(f"if(amount >= {low}D and amount < {high}D, 1, 0)").alias("band")]
    line = _entries(rows, "sender_key", OUT, [e for e, of in SENDER_ENDS.items() if of & wanted], census.horizon, keep,
                    unread | {"prev_gap", "next_gap"})
    paid = credits.filter(F.lit("secs_since_sender_inbound" in wanted)).selectExpr(
        "payee_key account", f"{PAID} kind", "event_us at", f"{TRANSFER} rank", "transaction_id id",
        f"{IN} half", "event_us paid_us")
    if confirmed is not None and "sender_flagged" in wanted:
        paid = paid.unionByName(flag_marks(confirmed, census.horizon), allowMissingColumns=True)
    else:
        paid = paid.withColumn("step", F.lit(0))
    if wanted & {"secs_since_sender_inbound", "sender_flagged"}:
        line = line.unionByName(paid if heavy else paid.repartition("account"), allowMissingColumns=True)
    else:
        line = line.withColumns({"paid_us": F.lit(None).cast("bigint"), "step": F.lit(0)})
    line = running(line, ["account"], PLACE, {
        "run_sent_10m": _window_sum("1", END_10M), "run_sent_1h": _window_sum("1", END_1H),
        "run_band_1h": _window_sum("band", END_1H), "run_sum_24h": _window_sum("money", END_24H),
        "run_payees_10m": _window_distinct(END_10M), "run_payees_24h": _window_distinct(END_24H),
        "run_payees_7d": _window_distinct(END_7D), "run_new_24h": _window_sum("new", END_24H),
        "run_new_sum_24h": _window_sum("new * money", END_24H), "run_flagged": _steps(FLAG),
        "hist": Moments(F.col("transfer.amount")),
        "login": Moments(F.expr("log1p(transfer.secs_login)")),
        "last_sent": Max(F.col("transfer.event_us"), before=True),
        "last_place": Max(F.expr("if(transfer.region_here <> '', struct(transfer.event_us us, "
                                 "transfer.transaction_id id, transfer.region_here region), null)"),
                          before=True),
        "home": Min(F.expr("if(transfer is null, null, struct(-transfer.region_count count, "
                           "transfer.region_first first, transfer.region_here region))"), before=True),
        "last_paid": Max(F.col("paid_us"), before=True),
    }, None if heavy else 0)
    line = line.filter("transfer is not null").drop("money", "prev_gap", "next_gap", "band", "new")
    if prior is not None:
        line = _after_prior(line, prior)
    mine = {n: e for n, e in sender_columns().items() if n in wanted}
    keep = [c for c in rows.columns if c not in
            {"region_here", "region_count", "region_first", "prev_gap", "next_gap", "pair_ever"} | unread]
    return (line.select("*", "transfer.*")
            .selectExpr(*[f"`{c}`" for c in keep], *[f"{e} as {n}" for n, e in mine.items()]))


def _after_prior(line: DataFrame, prior: Prior) -> DataFrame:
    """The sender's measures with what came before the input added."""
    homes = prior.regions.groupBy(F.col("sender_key").alias("account")).agg(
        F.min(F.struct((-F.col("region_count")).alias("count"), F.col("region_first").alias("first"),
                       F.col("region_here").alias("region"))).alias("home"))
    known = prior.senders.join(homes, "account", "left")
    known = known.select("account", *[F.col(c).alias(f"_c_{c}") for c in known.columns if c != "account"])
    line = line.join(known, "account", "left")
    carried = lambda c: F.col(f"_c_{c}")
    merged = {n: c for name in ("hist", "login") for n, c in Moments(F.lit(0)).merge(carried, name).items()}
    merged |= {c: F.greatest(F.col(c), carried(c)) for c in ("last_sent", "last_place")}
    merged["home"] = F.least(F.col("home"), carried("home"))
    return line.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in line.columns
                         if not c.startswith("_c_")])


def sender_columns() -> dict[str, str]:
    """Feature -> SQL over the running measures and the transfer's own columns."""
    moved = "(last_place is not null and region_here <> '' and region_here <> last_place.region)"
    since = f"((event_us - last_place.us) / {US}D)"
    km = f"coalesce({geo.distance_sql('last_place.region', 'region_here')}, 0D)"
    return {
        "log_amount": "log1p(amount)",
        "amount_to_mean": f"if(hist_mean > 0, amount / hist_mean, {S.NO_MEAN_RATIO}D)",
        "amount_z": "if(hist_std > 0, (amount - hist_mean) / hist_std, 0D)",
        "is_new_payee": "cast(pair_ever is null as int)",
        "vel_10m": "run_sent_10m",
        "vel_1h": "run_sent_1h",
        "distinct_payees_10m": "run_payees_10m",
        "sub_threshold_1h": "run_band_1h",
        "secs_since_last": f"coalesce((event_us - last_sent) / {US}D, {S.FIRST_TRANSFER_GAP}D)",
        "daily_sum_ratio": f"run_sum_24h / 100D / {S.DAILY_LIMIT}D",
        "hour": scalars.HOUR_SQL,
        "geo_is_anomaly": f"if(hist_n >= {S.MIN_REGION_HISTORY} and region_here <> home.region, 1, 0)",
        "secs_login_z": f"if(login_n >= {S.MIN_HISTORY} and login_std > {S.MIN_LOG_SPREAD}D, "
                        "(log1p(secs_login) - login_mean) / login_std, 0D)",
        "sender_payees_24h": "run_payees_24h",
        "sender_payees_7d": "run_payees_7d",
        "secs_since_sender_inbound": f"least(greatest(coalesce((event_us - last_paid) / {US}D, "
                                     f"{S.NEVER_PAID_GAP}D), 0D), {S.NEVER_PAID_GAP}D)",
        "sender_new_payees_24h": "run_new_24h",
        "sender_new_payee_sum_24h": "log1p(run_new_sum_24h / 100D)",
        "sender_flagged": "cast(run_flagged > 0 as int)",
        "travel_distance_km": f"if({moved}, {km}, 0D)",
        "travel_kmh": f"if({moved}, {km} / (greatest({since}, 1D) / 3600D), 0D)",
        "has_history": f"cast(hist_n >= {S.MIN_HISTORY} as int)",
        "amount_gt_factor_mean": f"if(hist_n < {S.MIN_HISTORY} or amount > {S.MEAN_FACTOR}D * hist_mean, 1, 0)",
    }


def transfer_features(transfers: DataFrame, confirmed: DataFrame | None = None,
                      profile: Profile = FULL, payee_side: bool = True,
                      prior: Prior | None = None, wanted: list[str] | None = None) -> DataFrame:
    """Every transfer with the features its profile can supply and the rule helpers.

    `confirmed` holds the confirmed accounts' half-open intervals (account, from_us, to_us).
    `prior` is what came before an input that begins a week or more before the transfers asked for.
    `payee_side` False reads the payee's side as nothing seen, as when its store is down.
    `wanted` names what a caller reads, features and the transfer's own columns: only those come back, with transaction_id and
    event_us, and the parts of the plan that only others need are left out.
    """
    if not profile.has("confirmed_cases"):
        confirmed = None
    chosen = set(wanted if wanted is not None else FEATURES + HELPERS)
    census = Census.of(transfers)
    own = [c for c in wanted or () if c in transfers.columns and c not in READ]
    rows = transfers if wanted is None else transfers.select(*READ, *own)
    # What the timelines need of a transfer's partners stands beside it in its entry.
    unread = set() if wanted is None else {"payee_key", "payer_id"} - chosen
    if chosen & PAYEE_SIDE and payee_side:
        rows = with_payee_features(rows, confirmed, census, prior, chosen, unread)
    if wanted is None or chosen - PAYEE_SIDE - set(transfers.columns):
        rows = with_sender_features(rows, transfers if wanted is None else transfers.select(*READ), confirmed, census, prior, chosen, unread)
    if not payee_side:
        rows = rows.withColumns({n: c for n, c in _nothing_seen().items() if n in chosen})
    if wanted is not None:
        return rows.select("transaction_id", "event_us", *wanted)
    unavailable = [f for f in FEATURES if f not in profile.feature_names]
    return rows.drop(*unavailable)


def _nothing_seen() -> dict[str, Column]:
    counts = ("rcv_distinct_senders_1h", "payee_payers_24h", "payee_payers_7d",
              "payee_new_payers_24h", "payee_flagged_contacts")
    return {**{f: F.lit(0).cast("bigint") for f in counts},
            **{f: F.lit(0.0) for f in ("rcv_inflow_1h", "payee_inflow_24h")},
            **{f: F.lit(0) for f in ("payee_flagged", "sender_flagged")},
            "secs_since_sender_inbound": F.lit(S.NEVER_PAID_GAP)}
