"""The features by definition: each one scans every earlier transfer. Slow, for tests only."""
import math
from collections import Counter

REGION_AT = {}


def km(a, b):
    from ledgerlens.functions.geo import EARTH_RADIUS_KM, REGIONS
    if a not in REGIONS or b not in REGIONS:
        return 0.0
    (la, lo), (lb, lp) = REGIONS[a], REGIONS[b]
    la, lo, lb, lp = map(math.radians, (la, lo, lb, lp))
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(x))


def features(rows, confirmed=()):
    """rows: dicts with transaction_id, us, sender, payer, payee, amount, region, call, secs.
    confirmed: (account, from_us, to_us or None)."""
    rows = sorted(rows, key=lambda r: (r["us"], r["transaction_id"]))
    out = {}
    for i, r in enumerate(rows):
        now, prior = r["us"], rows[:i]
        mine = [p for p in prior if p["sender"] == r["sender"]]
        paid = [p for p in prior if p["payee"] == r["payee"]]
        age = lambda p: (now - p["us"]) / 1e6
        within = lambda ps, s: [p for p in ps if age(p) <= s]
        flagged = lambda a: any(c == a and f <= now and (t is None or now < t) for c, f, t in confirmed)
        amounts = [p["amount"] for p in mine]
        n = len(amounts)
        mean = sum(amounts) / n if n else 0.0
        std = math.sqrt(sum((a - mean) ** 2 for a in amounts) / n) if n else 0.0
        if amounts and min(amounts) == max(amounts):
            mean, std = amounts[0], 0.0
        logs = [math.log1p(p["secs"]) for p in mine]
        lmean = sum(logs) / n if n else 0.0
        lstd = math.sqrt(sum((x - lmean) ** 2 for x in logs) / n) if n else 0.0
        first = lambda p: not any(q["payee"] == p["payee"] and q["sender"] == p["sender"]
                                  for q in rows[:rows.index(p)])
        new_day = [p for p in within(mine, 86400) if first(p)] + ([r] if first(r) else [])

        def unseen(p):
            before = [q for q in rows[:rows.index(p)] if q["payee"] == p["payee"] and q["payer"] == p["payer"]]
            return not before or (p["us"] - before[-1]["us"]) / 1e6 > 30 * 86400
        located = [p for p in mine if p["region"]]
        dist = speed = 0.0
        if located and r["region"] and located[-1]["region"] != r["region"]:
            dist = km(located[-1]["region"], r["region"])
            speed = dist / (max(age(located[-1]), 1.0) / 3600)
        geo = 0
        if n >= 3:
            counts = Counter(p["region"] or "" for p in mine)
            top = max(counts.values())
            home = next(p["region"] or "" for p in mine if counts[p["region"] or ""] == top)
            geo = int((r["region"] or "") != home)
        credits = [p for p in prior if p["payee"] == r["sender"]]
        contacts = set()
        for p in within(prior, 604800):
            if p["payee"] == r["payee"]:
                contacts.add(p["sender"])
            if p["sender"] == r["payee"]:
                contacts.add(p["payee"])
        band = lambda a: 8_000_000 <= a < 10_000_000
        day_sum = sum(p["amount"] for p in within(mine, 86400)) + r["amount"]
        out[r["transaction_id"]] = {
            "log_amount": math.log1p(r["amount"]),
            "amount_to_mean": r["amount"] / mean if mean > 0 else 4.0,
            "amount_z": (r["amount"] - mean) / std if std > 0 else 0.0,
            "is_new_payee": int(first(r)),
            "vel_10m": len(within(mine, 600)) + 1,
            "vel_1h": len(within(mine, 3600)) + 1,
            "distinct_payees_10m": len({p["payee"] for p in within(mine, 600)} | {r["payee"]}),
            "sub_threshold_1h": sum(band(p["amount"]) for p in within(mine, 3600)) + band(r["amount"]),
            "secs_since_last": age(mine[-1]) if mine else 86400.0,
            "daily_sum_ratio": day_sum / 100_000_000,
            "hour": float(now // 3_600_000_000 % 24),
            "rcv_distinct_senders_1h": len({p["payer"] for p in within(paid, 3600)} | {r["payer"]}),
            "rcv_inflow_1h": math.log1p(sum(p["amount"] for p in within(paid, 3600)) + r["amount"]),
            "geo_is_anomaly": geo,
            "active_call": r["call"],
            "secs_login_z": (math.log1p(r["secs"]) - lmean) / lstd if n >= 5 and lstd > 1e-6 else 0.0,
            "payee_payers_24h": len({p["payer"] for p in within(paid, 86400)} | {r["payer"]}),
            "payee_payers_7d": len({p["payer"] for p in within(paid, 604800)} | {r["payer"]}),
            "sender_payees_24h": len({p["payee"] for p in within(mine, 86400)} | {r["payee"]}),
            "sender_payees_7d": len({p["payee"] for p in within(mine, 604800)} | {r["payee"]}),
            "secs_since_sender_inbound": min(604800.0, age(credits[-1])) if credits else 604800.0,
            "payee_inflow_24h": math.log1p(sum(p["amount"] for p in within(paid, 86400)) + r["amount"]),
            "payee_new_payers_24h": sum(unseen(p) for p in within(paid, 86400) + [r]),
            "sender_new_payees_24h": len(new_day),
            "sender_new_payee_sum_24h": math.log1p(sum(p["amount"] for p in new_day)),
            "payee_flagged": int(flagged(r["payee"])),
            "sender_flagged": int(flagged(r["sender"])),
            "payee_flagged_contacts": sum(flagged(c) for c in contacts),
            "travel_distance_km": dist, "travel_kmh": speed,
            "has_history": int(n >= 5),
            "amount_gt_factor_mean": int(n < 5 or r["amount"] > 3 * mean),
        }
    return out


def stream(seed, n=150, accounts=12, days=40):
    """A random stream with ties, hubs, self-transfers, unknown and missing regions."""
    import random
    rng = random.Random(seed)
    names = ["Samarkand", "Andijan", "Navoi", "Atlantis", "", None]
    rows, us = [], 1_704_067_200_000_000
    for i in range(n):
        step = rng.choice([0, 0, 1, 1_000_000, 599_000_000, 600_000_000, 3_600_000_000, 3_600_000_001,
                           rng.randrange(0, 86_400_000_000), rng.randrange(0, days * 2 * 86_400_000_000 // n)])
        us += step
        hub = rng.random() < 0.4
        s = "A1" if rng.random() < 0.3 else f"A{rng.randrange(accounts)}"
        rows.append({"transaction_id": f"{rng.randrange(10**6):06d}-{i}", "us": us, "sender": s,
                     "payer": "p" + s, "payee": "A2" if hub else f"A{rng.randrange(accounts)}",
                     "amount": float(rng.choice([9_000_000, 9_000_000, 100_000, 2_500_000, rng.randrange(1, 60_000_000)])),
                     "region": rng.choice(names), "call": rng.randrange(2),
                     "secs": float(rng.choice([30, 30, 45, rng.randrange(1, 400)]))})
    return rows


def as_transfers(spark, rows):
    schema = ("transaction_id string, event_us bigint, sender_key string, payer_id string, payee_key string, "
              "amount double, sender_region string, active_call int, secs_login double, amount_tiyin bigint")
    return spark.createDataFrame(
        [(r["transaction_id"], r["us"], r["sender"], r["payer"], r["payee"], r["amount"], r["region"],
          r["call"], r["secs"], round(r["amount"] * 100)) for r in rows], schema)
