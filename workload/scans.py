"""Sources, sinks and cleaning."""

from pyspark.sql import functions as F

from tickloom.functions import price as P
from tickloom.plans import features as X
from tickloom.sources import sinks, ticks as src
from tickloom.storage import new_path
from workload.base import hit, TICK_SQL, ordered, query, r6, signal_cte, signals, table, tick_cte, ticks

WITH_T = f"WITH {TICK_SQL}"


@query("s01_tick_scan", f"{WITH_T} SELECT epoch AS time, symbol, {r6('price', 'price')}, digit FROM t")
def _(spark, d):
    path = new_path(spark, "ticks")
    sinks.write_result(ticks(spark, d).select(F.col("epoch").alias("time"), "symbol", "price", "digit"), path)
    return src.read_ticks(spark, path)


@query("s02_feature_scan", tick_cte() + f" SELECT symbol, tie, {r6('delta', 'delta')}, {r6('vol10', 'vol10')} FROM f")
def _(spark, d):
    path = new_path(spark, "features")
    sinks.write_result(X.v4(ordered(spark, d)).frame(), path, "parquet")
    return src.read_features(spark, path, ["symbol", "tie", "delta", "vol10"])


@query("s03_required_columns", "SELECT event_id, ts, value FROM events")
def _(spark, d):
    return src.require_columns(table(spark, d, "events"), ["ts", "value"]).select("event_id", "ts", "value")


@query("s04_column_pick", "SELECT event_id, event_type FROM events")
def _(spark, d):
    return src.picked(table(spark, d, "events"), ["event_id", "event_type", "digit_entropy_10", "vol5"])


@query("s05_tail_read", f"{WITH_T} SELECT tie, symbol, {r6('price', 'price')}, digit FROM t ORDER BY time DESC, tie DESC LIMIT 5000")
def _(spark, d):
    return src.last_rows(ticks(spark, d), 5000, ["time", "tie"]).select("tie", "symbol", "price", "digit")


@query("s06_result_sink", f"{WITH_T} SELECT symbol, CAST(count(*) AS BIGINT) AS observations, {r6('avg(price)', 'mean_price')} FROM t GROUP BY symbol")
def _(spark, d):
    path = new_path(spark, "result")
    sinks.write_result(ticks(spark, d).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("observations"), F.avg("price").alias("mean_price")), path)
    return spark.read.schema("symbol string, observations bigint, mean_price double").option("header", True).csv(path)


@query("s07_feature_sink", tick_cte() + """ SELECT symbol, strftime(time, '%Y-%m-%d') AS date, count(*) AS n,
  count(vol10) AS with_volatility FROM f GROUP BY ALL""")
def _(spark, d):
    path = new_path(spark, "features")
    feats = X.v4(ordered(spark, d)).frame().withColumn("date", F.date_format("time", "yyyy-MM-dd"))
    sinks.write_features(feats, path)
    back = spark.read.schema(feats.schema).parquet(path)
    return back.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"), F.count("vol10").alias("with_volatility"))


@query("s08_append_sink", f"{WITH_T} SELECT symbol, digit, count(*) AS n FROM t GROUP BY ALL")
def _(spark, d):
    path = new_path(spark, "appended")
    rows = ticks(spark, d).select(F.col("epoch").alias("time"), "symbol", "price", "digit")
    sinks.append_rows(rows.where(F.col("digit") < 5), path)
    sinks.append_rows(rows.where(F.col("digit") >= 5), path)
    return src.read_ticks(spark, path).groupBy("symbol", "digit").agg(F.count(F.lit(1)).alias("n"))


@query("s09_signal_detail", signal_cte() + """ SELECT symbol, tie, row, next_digit, 1 AS h3_signal, 3 AS target_digit,
  hit AS correct_prediction FROM s""")
def _(spark, d):
    return sinks.signal_detail(signals(spark, d).frame(), 3).select(
        "symbol", "tie", "row", "next_digit", "h3_signal", "target_digit", "correct_prediction")


@query("s10_high_water_mark", f"{WITH_T} SELECT max(epoch) AS last_time FROM t")
def _(spark, d):
    return src.high_water_mark(ticks(spark, d), "epoch")


@query("s11_stored_rows", "SELECT count(*) AS saved, count(*) >= 60000 AS target_reached FROM events")
def _(spark, d):
    return src.stored_rows(table(spark, d, "events"), 60_000)


def history_messages(spark, d):
    """History messages as a server would send them: one per symbol and hour, parallel arrays."""
    hour = F.floor(F.col("epoch") / 3600)
    rows = F.array_sort(F.collect_list(F.struct(F.col("epoch").alias("time"), F.col("price"))))
    return ticks(spark, d).groupBy("symbol", hour.alias("hour")).agg(rows.alias("rows")).select(
        "symbol", "hour", F.col("rows.price").alias("prices"), F.col("rows.time").alias("times"))


@query("s12_back_fill", f"""{WITH_T}, m AS (SELECT symbol, min(epoch) + (max(epoch) - min(epoch)) // 2 AS cut FROM t GROUP BY symbol),
h AS (SELECT symbol, max(epoch) AS mark FROM t JOIN m USING (symbol) WHERE epoch <= cut GROUP BY symbol)
SELECT symbol, epoch AS time, count(*) > 0 AS added FROM t JOIN h USING (symbol) WHERE epoch > mark GROUP BY symbol, epoch""")
def _(spark, d):
    t = ticks(spark, d).select("symbol", F.col("epoch").alias("time"), "price")
    middle = t.groupBy("symbol").agg((F.min("time") + F.floor((F.max("time") - F.min("time")) / 2)).alias("cut"))
    stored = t.join(middle, "symbol").where(F.col("time") <= F.col("cut")).drop("cut")
    offered = src.zip_history(history_messages(spark, d), F.col("prices"), F.col("times"), ["symbol"])
    return src.back_fill(stored, offered).select("symbol", "time", F.lit(True).alias("added"))


@query("s13_prediction_stats", signal_cte() + " SELECT count(hit) AS predictions, CAST(coalesce(sum(hit), 0) AS BIGINT) AS correct FROM s")
def _(spark, d):
    return src.prediction_stats(signals(spark, d).frame().select(P.flag(hit()).alias("correct")))


@query("p01_numeric_coercion", """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) + 0.0 AS k,
  TRY_CAST(event_type AS DOUBLE) AS kind FROM events""")
def _(spark, d):
    raw = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"),
                                           F.col("event_type").alias("kind"))
    return src.coerced(raw, {"k": "double", "kind": "double"})


@query("p02_drop_nulls", tick_cte() + f" SELECT symbol, tie, {r6('vol10', 'vol10')} FROM f WHERE vol10 IS NOT NULL AND next_digit IS NOT NULL")
def _(spark, d):
    feats = X.signal_inputs(ordered(spark, d)).frame()
    return src.complete(feats, ["vol10", "next_digit"]).select("symbol", "tie", "vol10")


TWO_STAGE = """WITH v AS (SELECT event_type AS symbol, ts, event_id AS tie, value AS price,
  CAST(round(value * 100) AS BIGINT) % 10 AS digit FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 10),
d AS (SELECT *, price - lag(price) OVER w AS delta FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts, tie)),
f AS (SELECT *, CASE WHEN count(delta) OVER v10 = 10 THEN stddev_samp(delta) OVER v10 END AS vol10 FROM d
  WINDOW v10 AS (PARTITION BY symbol ORDER BY ts, tie ROWS 9 PRECEDING))
SELECT symbol, tie, round(delta, 6) + 0.0 AS delta, round(vol10, 6) + 0.0 AS vol10 FROM f WHERE vol10 IS NOT NULL"""


@query("p03_two_stage_drop", TWO_STAGE)
def _(spark, d):
    # A price is invalid where its message number has one digit: it leaves before any neighbour is taken.
    events = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    valid = src.coerced(events, {"k": "double"}).withColumn("value", F.when(F.col("k") >= 10, F.col("value")))
    seq = src.in_time_order(src.as_ticks(valid, "ts", "value", "event_id", "event_type"))
    return X.usable(seq.derive(X.price_delta, X.volatility(10), back=10), "vol10").frame().select(
        "symbol", "tie", "delta", "vol10")


@query("p04_time_sort", f"{WITH_T} SELECT symbol, tie, row_number() OVER (PARTITION BY symbol ORDER BY time, tie) - 1 AS pos FROM t")
def _(spark, d):
    return ordered(spark, d).number("pos").frame().select("symbol", "tie", "pos")


@query("p05_file_order", f"{WITH_T} SELECT tie, row_number() OVER (ORDER BY tie) - 1 AS pos, {r6('price - lag(price) OVER (ORDER BY tie)', 'delta')} FROM t")
def _(spark, d):
    return src.in_file_order(ticks(spark, d)).derive(X.price_delta, back=1, pos="pos").frame().select("tie", "pos", "delta")


def column_query(name, columns, sql):
    @query(name, f"{WITH_T} SELECT tie, {sql} FROM t")
    def _(spark, d):
        return ticks(spark, d).select("tie", *[c.alias(n) for n, c in columns().items()])


FRAC = "(price - floor(price))"
column_query("p06_last_digit", lambda: {"digit": P.last_digit(F.col("price"))}, "digit")
column_query("p07_parity", lambda: {"parity": P.parity(F.col("digit")), "parity_name": P.parity_name(F.col("digit"))},
             "digit % 2 AS parity, CASE WHEN digit % 2 = 0 THEN 'Even' ELSE 'Odd' END AS parity_name")
column_query("p10_round_distance", lambda: {"round_distance": P.round_distance(F.col("price"))}, r6(f"least({FRAC}, 1 - {FRAC})", "round_distance"))
column_query("p11_half_distance", lambda: {"half_distance": P.half_distance(F.col("price"))}, r6(f"abs({FRAC} - 0.5)", "half_distance"))
column_query("p13_zoned_hour", lambda: {"hour_utc": P.hour_of(F.col("epoch")), "hour_nairobi": P.hour_of(F.col("epoch"), "Africa/Nairobi")},
             "CAST(hour(time) AS INTEGER) AS hour_utc, CAST(hour(time + INTERVAL 3 HOUR) AS INTEGER) AS hour_nairobi")


@query("p08_infinity_to_null", tick_cte() + f""" SELECT symbol, tie, {r6("CASE WHEN delta <> 0 THEN price / delta END", 'ratio')} FROM f""")
def _(spark, d):
    seq = ordered(spark, d).derive(X.price_delta, back=1)
    delta = F.col("delta")
    ratio = F.when(delta == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("price"), delta))
    return seq.frame().select("symbol", "tie", P.finite(ratio).alias("ratio"))


@query("p09_absolute_delta", tick_cte() + f" SELECT symbol, tie, {r6('abs(delta)', 'absolute_delta')} FROM f")
def _(spark, d):
    return X.v4(ordered(spark, d)).frame().select("symbol", "tie", "absolute_delta")


@query("p12_digit_distance", tick_cte() + " SELECT symbol, tie, abs(previous_digit - 3) AS digit_distance FROM f", ["digit_distance"])
def _(spark, d):
    seq = ordered(spark, d).derive(X.lags, back=10)
    return seq.frame().select("symbol", "tie", P.digit_distance(F.col("previous_digit"), 3).alias("digit_distance"))


@query("p14_predicates", tick_cte() + """ SELECT symbol, tie FROM f WHERE previous_digit IN (0, 1, 2)
  AND next_digit BETWEEN 3 AND 6 AND NOT (delta > 0) AND (vol10 <= 60 OR vol10 >= 90)""")
def _(spark, d):
    v = F.col("vol10")
    seq = X.signal_inputs(ordered(spark, d)).where(
        F.col("previous_digit").isin(0, 1, 2) & F.col("next_digit").between(3, 6) & ~(F.col("delta") > 0)
        & ((v <= 60) | (v >= 90)))
    return seq.frame().select("symbol", "tie")
