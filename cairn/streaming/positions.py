"""A feed of positions: fix quality, arrivals, announcements, leaving the route."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import geo
from ..operators.groups import dealt


def fix_quality(*, available: Column, fixed: Column, age_s: Column, accuracy_m: Column, most_age_s: float = 15, most_accuracy_m: float = 50) -> Column:
    """unavailable, waiting (no fix yet), stale, poor or good; only a good fix may change state. An unknown accuracy is not poor."""
    return F.when(~available, "unavailable").when(~fixed, "waiting").when(age_s > most_age_s, "stale").when(accuracy_m > most_accuracy_m, "poor").otherwise("good")


def arrivals(feed: DataFrame, stops: DataFrame, metres: float = 40.0) -> DataFrame:
    """feed (user_id, ts, lat, lon; may be a stream) joined to the stops (route of the user) it has arrived at."""
    there = stops.select("user_id", "ordinal", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"))
    return feed.join(there, "user_id").where(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) <= metres).select("user_id", "ts", "ordinal")


def announced_once(feed: DataFrame, keys: list[str], *, late: str = "10 minutes") -> DataFrame:
    """Of a stream of (keys, ts), each combination of the keys once within the watermark."""
    return feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def off_route(feed: DataFrame, *, in_a_row: int = 2) -> DataFrame:
    """user_id, event_id, ts, off: off the route once so many good fixes in a row were too far. feed: user_id, event_id, ts, far (good fixes only).

    Fixes count in the order of ts and event_id within a batch, and batches as they come.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        off = []
        for far in rows["far"]:
            run = run + 1 if far else 0
            off.append(run >= in_a_row)
        state.update((run,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "ts": rows["ts"], "off": off})

    kind = dict(feed.dtypes)["ts"]
    return feed.groupBy("user_id").applyInPandasWithState(step, f"user_id long, event_id long, ts {kind}, off boolean", "run int", "append", GroupStateTimeout.NoTimeout)


#: Fixed values of a guide, in metres: where a stop is reached, how far a walk may slide back, and what is off its line.
ARRIVED_M = 40.0
BACKWARD_M = 15.0
OFF_ROUTE_M = 60.0
GUIDE_STATE = "travelled double, run int, next int, ts double, event_id long"


def guided(feed: DataFrame, walks: DataFrame, *, in_a_row: int = 2, late: str = "10 minutes", forget_s: int = 12 * 3600) -> DataFrame:
    """user_id, event_id, ts, off_line_m, travelled, off, arrived: what a guide knows after each fix of a feed (may be a stream).

    feed: user_id, event_id, ts, lat, lon, good; walks: user_id, line (array of struct(lon, lat)), stops (the same). Only a
    good fix tells how far the line is and moves the guide: travelled is the farthest point on the line, less BACKWARD_M;
    arrived is the number of the next stop (from 1) when it is reached; off is true from so many good fixes in a row that
    are off the line and not near the next stop (twice ARRIVED_M). Any other fix ends such a run.

    Fixes count in the order of ts and event_id within a batch; one that is not later than what its user's state has
    seen (repeated, or overtaken) is left out. A user's state goes forget_s after its last fix, by the watermark.
    """
    here = geo.located(F.col("line"), F.col("lat"), F.col("lon"))
    # Dealt out first: what is worked out on each fix isn't left to the few tasks that read a batch's files.
    met = dealt(feed.withWatermark("ts", late), "user_id").join(walks.select("user_id", "line", "stops"), "user_id").withColumn("at", here)
    to_stops = F.transform("stops", lambda s: geo.haversine_m(F.col("lat"), F.col("lon"), s["lat"], s["lon"]))
    good = F.coalesce(F.col("good"), F.lit(False)) & F.col("at").isNotNull()
    rows = met.select("user_id", "event_id", "ts", F.when(good, F.col("at.metres")).alias("off_line_m"), F.col("at.along").alias("along"), to_stops.alias("to_stops"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        travelled, run, ahead, seen, last = state.get if state.exists else (0.0, 0, 0, -1.0, -1)
        # A user's rows are few: plain columns cost less than frames made for each.
        parts = list(batches)
        own = {c: np.concatenate([b[c].to_numpy() for b in parts]) for c in ("event_id", "ts", "off_line_m", "along", "to_stops")}
        order = np.lexsort((own["event_id"], own["ts"]))
        own = {c: v[order] for c, v in own.items()}
        moments = own["ts"].astype("datetime64[us]").astype(np.int64) / 1e6
        kept, found = [], []
        for i, (event, moment, off_m, along, stops) in enumerate(zip(own["event_id"].tolist(), moments.tolist(), own["off_line_m"].tolist(), own["along"].tolist(), own["to_stops"], strict=True)):
            if (moment, event) <= (seen, last):
                continue
            seen, last, arrived = moment, event, None
            if off_m != off_m:  # none
                run = 0
            else:
                travelled = max(travelled, along - BACKWARD_M)
                near = stops[ahead] if ahead < len(stops) else float("inf")
                run = run + 1 if off_m > OFF_ROUTE_M and near > 2 * ARRIVED_M else 0
                if near <= ARRIVED_M:
                    ahead += 1
                    arrived = ahead
            kept.append(i)
            found.append((travelled, run >= in_a_row, arrived))
        state.update((travelled, run, ahead, seen, last))
        state.setTimeoutTimestamp(max(int(seen), state.getCurrentWatermarkMs() // 1000) * 1000 + forget_s * 1000)
        far, off, arrived = zip(*found, strict=True) if found else ((), (), ())
        own = {c: own[c][kept] for c in ("event_id", "ts", "off_line_m")} if kept else {c: own[c][:0] for c in ("event_id", "ts", "off_line_m")}
        yield pd.DataFrame({"user_id": np.full(len(kept), key[0]), **own, "travelled": np.array(far, float), "off": np.array(off, bool), "arrived": pd.array(arrived, "Int32")})

    return rows.groupBy("user_id").applyInPandasWithState(step, f"user_id long, event_id long, ts {dict(feed.dtypes)['ts']}, off_line_m double, travelled double, off boolean, arrived int", GUIDE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
