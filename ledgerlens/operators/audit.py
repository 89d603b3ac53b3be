"""Hashes that bind a decision to its event and to the decisions before it, and their check."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import spread

# The hashed fields of an event, in order.
INGRESS_FIELDS = ("transaction_id", "event_time", "sender_pinfl", "sender_card", "receiver_card",
                  "amount_uzs", "sender_region")
GENESIS = "0" * 64
JOINER = "\x1f"


def _joined(*values: Column) -> Column:
    # concat_ws drops nulls, which would move every later field.
    return F.concat_ws(JOINER, *[F.coalesce(v.cast("string"), F.lit("")) for v in values])


def ingress_hash(*fields: Column) -> Column:
    """SHA-256 of the raw event's fields; null counts as empty."""
    return F.sha2(_joined(*(fields or [F.col(f) for f in INGRESS_FIELDS])), 256)


def record_hash(prev: Column, seq: Column, ingress: Column, payload: Column) -> Column:
    """A chain link: the previous hash, the position and the content."""
    before = F.when(F.coalesce(prev, F.lit("")) == "", GENESIS).otherwise(prev)
    return F.sha2(_joined(before, seq, ingress, payload), 256)


def audit_core(records: DataFrame) -> DataFrame:
    """The content of an audit record: the decision's columns and its full JSON."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return records.select(
        text("transaction_id"), "event_time", text("decision"),
        F.coalesce("final_score", F.lit(0.0)).cast("float").alias("final_score"),
        text("model_version"), F.coalesce("rule_hits", F.array().cast("array<string>")).alias("rule_hits"),
        F.to_json(F.struct(*records.columns)).alias("payload"), text("ingress_hash"))


def _link(batches):
    """Walk one partition's chains in order, one Arrow batch at a time; only each chain's last place
    and hash are held."""
    chain = last = seq = None
    for pdf in batches:
        seq_col, prev_col, hash_col = [], [], []
        for cid, begin, start, ingress, payload in zip(pdf["chain_id"], pdf["_from"], pdf["start_hash"],
                                                       pdf["ingress_hash"], pdf["payload"]):
            if cid != chain:
                chain, last, seq = cid, start, begin - 1
            seq += 1
            text = JOINER.join((last, str(seq), ingress or "", payload or ""))
            seq_col.append(seq)
            prev_col.append(last)
            last = hashlib.sha256(text.encode("utf-8")).hexdigest()
            hash_col.append(last)
        yield pdf.drop(columns=["_from", "start_hash"]).assign(seq=seq_col, prev_hash=prev_col, record_hash=hash_col)


#: Records that one walker takes on, in a load that chooses its own number of chains.
CHAIN_RECORDS = 1_000_000


def chains_for(records: int, least: int = 8) -> int:
    """Chains for a load of so many records: they grow with it, so that a walker's share does not."""
    return max(least, -(-records // CHAIN_RECORDS))


def chain_ends(log: DataFrame) -> DataFrame:
    """chain_id, seq and record_hash of each chain's last record."""
    return log.groupBy("chain_id").agg(F.max_by("record_hash", "seq").alias("record_hash"), F.max("seq").alias("seq")).select(
        "chain_id", "seq", "record_hash")


def append_chain(core: DataFrame, order: list[str], chains: int = 1,
                 tails: DataFrame | None = None) -> DataFrame:
    """`core` with chain_id, seq, prev_hash and record_hash, going on from each chain's tail.

    A chain is serial by definition: one task walks it, streaming. `chains` spreads the records
    over that many independent chains, so a large load has as many walkers; 1 is the plain log.
    """
    rows = core.withColumn("chain_id", spread(F.col("transaction_id"), chains))
    if tails is None:
        rows = rows.withColumns({"_from": F.lit(0).cast("bigint"), "start_hash": F.lit(GENESIS)})
    else:
        ends = chain_ends(tails).select("chain_id", F.col("seq").alias("_seq"), F.col("record_hash").alias("_hash"))
        rows = rows.join(ends, "chain_id", "left").withColumns({
            "_from": F.coalesce(F.col("_seq") + 1, F.lit(0).cast("bigint")),
            "start_hash": F.coalesce("_hash", F.lit(GENESIS))}).drop("_seq", "_hash")
    # A task for each chain: hashing would put several of a few chains into one task, and sampled ranges may.
    ordered = rows.repartitionById(chains, F.col("chain_id")).sortWithinPartitions("chain_id", *order)
    names = [c for c in ordered.columns if c not in ("_from", "start_hash")]
    schema = ordered.select(*names).withColumns({"seq": F.lit(0).cast("bigint"), "prev_hash": F.lit(""), "record_hash": F.lit("")}).schema
    return ordered.mapInPandas(_link, schema)


def verify_chain(log: DataFrame, window: int | None = None) -> DataFrame:
    """Findings (chain_id, seq, finding); no row means the log is intact.

    Each link is recomputed where it lies and tells its own place what it found, and the place after it which hash to expect: one
    shuffle by position brings both together, whatever the length of a chain. With `window` only the latest records are read, and the
    link into the first of them is not checked; without it a chain must begin at genesis.
    """
    if "chain_id" not in log.columns:
        log = log.withColumn("chain_id", F.lit(0))
    if window is not None:
        newest = log.groupBy("chain_id").agg(F.max("seq").alias("_newest"))
        log = log.join(newest, "chain_id").filter(F.col("seq") > F.col("_newest") - window).drop("_newest")
    heads = log.groupBy("chain_id").agg(F.min("seq").alias("head"))
    payload = F.try_parse_json("payload")
    field = lambda name: F.coalesce(F.get_json_object("payload", f"$.{name}"), F.lit(""))
    broken = payload.isNull()
    own = {"content altered": record_hash(F.col("prev_hash"), F.col("seq"), F.col("ingress_hash"), F.col("payload")) != F.col("record_hash"),
           "decision differs from payload": ~broken & (field("decision") != F.col("decision")),
           "id differs from payload": ~broken & (field("transaction_id") != F.col("transaction_id")),
           "payload is not JSON": broken}
    told = log.select("chain_id", F.inline(F.array(
        F.struct("seq", F.lit(1).alias("here"), "prev_hash", F.lit(None).cast("string").alias("expected"),
                 *[F.coalesce(c, F.lit(False)).cast("int").alias(f"_{i}") for i, c in enumerate(own.values())]),
        F.struct((F.col("seq") + 1).alias("seq"), F.lit(0).alias("here"), F.lit(None).cast("string").alias("prev_hash"),
                 F.col("record_hash").alias("expected"), *[F.lit(0).alias(f"_{i}") for i in range(len(own))]))))
    places = told.groupBy("chain_id", "seq").agg(
        F.sum("here").alias("n"), F.min("prev_hash").alias("prev_hash"), F.max("prev_hash").alias("prev_high"),
        F.max("expected").alias("expected"), *[F.sum(f"_{i}").cast("int").alias(f"_{i}") for i in range(len(own))]).filter("n > 0")
    # A record taken twice is a finding of its own, and each copy has its own others.
    first = F.col("seq") == F.col("head")
    other = lambda hash_: (F.col("prev_hash") != hash_) | (F.col("prev_high") != hash_)
    head_off = F.lit(False) if window is not None else first & other(F.lit(GENESIS))
    gap = ~first & F.col("expected").isNull()
    off = gap | head_off | (~first & other(F.col("expected")))
    times = {**{text: F.col(f"_{i}") for i, text in enumerate(own)}, "position repeated": (F.col("n") > 1).cast("int"),
             "gap before": gap.cast("int"), "previous hash differs": F.coalesce(off, F.lit(False)).cast("int")}
    found = F.flatten(F.array(*[F.array_repeat(F.lit(text), n) for text, n in times.items()]))
    return places.join(heads, "chain_id").select("chain_id", "seq", F.explode(found).alias("finding"))


def chain_heads(log: DataFrame) -> DataFrame:
    """Each chain's length and latest hash, to be published elsewhere as an anchor."""
    return log.groupBy("chain_id").agg(F.count(F.lit(1)).alias("records"), F.min("seq").alias("first_seq"),
                                       F.max("seq").alias("last_seq"),
                                       F.max_by("record_hash", "seq").alias("head_hash"))
