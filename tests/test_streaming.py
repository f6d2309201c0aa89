import json
import random
import time
from unittest.mock import MagicMock

import pytest

from tickloom.streaming import live as V
from tickloom.streaming import messages as Y
from tickloom.streaming import symbol_state as Z

RULE = V.Rule(delta=-0.1, volatility=5.0, previous_digit=4, prices=5)
COLUMNS = [c.split()[0] for c in V.PREDICTION.split(", ")]


def make(n, seed=0):
    rng = random.Random(seed)
    # One symbol has most of the traffic.
    return [("hot" if rng.random() < 0.7 else rng.choice("ab"), t, round(rng.uniform(1, 3), 2)) for t in range(1, n + 1)]


def write(folder, name, rows):
    path = folder / name
    path.mkdir(parents=True)
    lines = [json.dumps({"msg_type": "tick", "tick": {"quote": p, "epoch": t, "symbol": s}}) for s, t, p in rows]
    (path / "part.txt").write_text("\n".join(lines + ['{"msg_type": "ping"}', "not json"]) + "\n")


def stream(spark, folder, files=1):
    return Y.tick_rows(Y.message_files(spark, f"{folder}/*", files))


def expected(spark, rows):
    df = spark.createDataFrame(rows, "symbol string, time bigint, price double")
    lines = df.selectExpr("to_json(struct('tick' AS msg_type, struct(price AS quote, time AS epoch, symbol) AS tick)) AS value")
    return key(V.batch_predictions(Y.tick_rows(lines), RULE))


def key(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in COLUMNS)) for r in df.collect())


@pytest.mark.parametrize("compact_every", [0, 2])
def test_small_batches_restart_and_duplicates(spark, tmp_path, compact_every):
    rows = make(400)
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    write(inbox, "1", rows[:90])
    write(inbox, "2", rows[90:91])
    V.run_available(stream(spark, inbox), V.LivePrediction(spark, out, RULE, every=10), mark)
    # After the restart an old part comes again; its ticks are not newer and are ignored.
    write(inbox, "3", rows[60:250])
    write(inbox, "4", rows[250:])
    handler = V.LivePrediction(spark, out, RULE, every=10, compact_every=compact_every)
    V.run_available(stream(spark, inbox), handler, mark)
    want = expected(spark, rows)
    assert len(list((tmp_path / "out" / "predictions").iterdir())) == (4 if not compact_every else 5 - compact_every)
    assert len(want) > 3 and key(handler.predictions()) == want
    # A repeated micro-batch replaces its own output.
    last = spark.createDataFrame(rows[250:], "symbol string, time bigint, price double")
    lines = last.selectExpr("to_json(struct('tick' AS msg_type, struct(price AS quote, time AS epoch, symbol) AS tick)) AS value")
    handler(Y.tick_rows(lines), 3)
    assert key(handler.predictions()) == want
    assert sum(r["predictions"] for r in handler.accuracy().collect()) == len(want)
    assert handler.totals().first()["predictions"] == len(want)
    status = handler.status().collect()
    hot = sum(1 for r in rows if r[0] == "hot")
    assert max(r["ticks"] for r in status if r["symbol"] == "hot") == hot // 10 * 10
    assert {r["symbol"]: r["ticks"] for r in handler.accuracy().collect()}["hot"] == hot
    for r in status:
        at = [t for s, t, _ in rows if s == r["symbol"]][r["ticks"] - 1]
        seen = [w[-1] for w in want if w[0] == r["symbol"] and w[2] <= at]
        assert (r["predictions"], r["correct"]) == (len(seen), sum(seen))


def test_state_store_version_agrees(spark, tmp_path):
    rows = make(300, 2)
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    for i in range(3):
        write(inbox, str(i), rows[i * 100:(i + 1) * 100])
    with Z.state_store(spark):
        V.append_available(Z.stateful_predictions(stream(spark, inbox), RULE), out, mark)
        buffer, totals = (df.collect() for df in Z.symbol_states(spark, mark))
    want = expected(spark, rows)
    assert key(spark.read.schema(V.PREDICTION).parquet(out)) == want
    for symbol in ("hot", "a", "b"):
        own = [r for r in rows if r[0] == symbol]
        assert sorted((r.time, r.price) for r in buffer if r.symbol == symbol) == [(t, p) for _, t, p in own[-RULE.prices:]]
        total = next(r for r in totals if r.symbol == symbol)
        hits = [r[-1] for r in want if r[0] == symbol]
        assert (total.ticks, total.predictions, total.correct) == (len(own), len(hits), sum(hits))
        assert total.signals == len(hits) + total.pending


def test_idle_symbols_leave_the_state(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    with Z.state_store(spark):
        for i in range(2):
            write(inbox, str(i), [("old" if i == 0 else "new", i * 1000 + k, 1.5 + k) for k in range(8)])
            V.append_available(Z.stateful_predictions(stream(spark, inbox), RULE, idle=100), out, mark)
        buffer, totals = (df.collect() for df in Z.symbol_states(spark, mark))
    assert [(r.symbol, r.ticks) for r in totals] == [("new", 8)] and {r.symbol for r in buffer} == {"new"}


def test_disordered_files_lose_nothing(spark, tmp_path):
    """24 files in any order, with repeated ticks and equal times: what a stored table gives, in batch and stream."""
    rows = make(480, 5)
    rng = random.Random(6)
    rows += [(s, t, round(p + 0.5, 2)) for s, t, p in rng.sample(rows, 40)]
    want = expected(spark, rows)
    shuffled = rng.sample(rows, len(rows))
    assert len(want) > 3 and expected(spark, shuffled) == want
    inbox = tmp_path / "in"
    for i in range(24):
        write(inbox, f"{i:02d}", shuffled[i::24])
    handler = V.LivePrediction(spark, str(tmp_path / "out"), RULE, delay=500)
    V.run_available(stream(spark, inbox, 8), handler, str(tmp_path / "mark"))
    assert key(handler.predictions()) == []
    handler.close()
    assert key(handler.predictions()) == want
    # Nearly ordered: a short delay is enough, and most is out before the end.
    near = sorted(rows, key=lambda r: (r[1] + rng.randint(-15, 15)))
    inbox = tmp_path / "near"
    for i in range(6):
        write(inbox, f"{i:02d}", near[i * 90:(i + 1) * 90])
    handler = V.LivePrediction(spark, str(tmp_path / "out2"), RULE, delay=40)
    V.run_available(stream(spark, inbox), handler, str(tmp_path / "mark2"))
    early = key(handler.predictions())
    handler.close()
    assert len(early) > 0 and set(early) <= set(want) and key(handler.predictions()) == want


def test_signal_on_the_last_tick_stays_pending(spark):
    rows = make(200, 3)
    whole = expected(spark, rows)
    result_time = whole[-1][COLUMNS.index("result_time")]
    cut = [r for r in rows if r[1] < result_time]
    assert whole[-1] not in expected(spark, cut)


def test_history_and_rejected_messages(spark):
    lines = [('{"msg_type": "history", "history": {"prices": [1.25, 1.5], "times": [10, 12]}}', "A"),
             ('{"error": "rate limit"}', "A"), ('{"msg_type": "tick"}', "A"), ("junk", "A")]
    df = spark.createDataFrame(lines, "value string, symbol string")
    got = sorted((r["time"], r["price"], r["digit"]) for r in Y.history_rows(df, keys=["symbol"]).collect())
    assert got == [(10, 1.25, 5), (12, 1.5, 0)]
    assert Y.rejected(df).count() == 3


def test_bounded_collection_stops_at_the_target(spark, tmp_path):
    rows = make(120, 4)
    inbox, out, mark = tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    write(inbox, "0", rows[:30])
    # Ends without the target, as nothing more comes; then goes on from the checkpoint.
    assert not V.run_until(stream(spark, inbox), V.BoundedCollection(spark, str(out), 75), mark, 2)
    for i in range(1, 4):
        write(inbox, str(i), rows[i * 30:(i + 1) * 30])
    sink = V.BoundedCollection(spark, str(out), 75)
    assert V.run_until(stream(spark, inbox), sink, mark)
    assert sink.saved() == 75 and sink.saved(2) == 60
    assert sorted(r["time"] for r in sink.rows().collect()) == list(range(1, 76))
    # What still comes writes no version, and a repeated micro-batch replaces its own.
    V.run_available(stream(spark, inbox), sink, mark)
    sink(Y.tick_rows(spark.read.text(str(inbox / "2"))), 2)
    sink(Y.tick_rows(spark.read.text(str(inbox / "3"))), 3)
    assert sorted(p.name for p in (out / "ticks").iterdir()) == ["batch=0", "batch=1", "batch=2"]
    assert sorted(r["time"] for r in sink.rows().collect()) == list(range(1, 76))


def test_a_stream_that_keeps_looking_for_data_ends_when_none_comes():
    query, handler, looks = MagicMock(lastProgress=None), MagicMock(), []
    handler.reached.return_value = False

    def look(seconds):
        looks.append(seconds)
        assert len(looks) < 1_000
        time.sleep(0.01)
        query.status = {"isDataAvailable": False, "isTriggerActive": True, "message": "Waiting for data to arrive"
                        if len(looks) % 3 == 0 else "Getting offsets from FileStreamSource"}

    query.awaitTermination.side_effect = look
    frame = MagicMock()
    frame.writeStream.foreachBatch.return_value.option.return_value.start.return_value = query
    assert not V.run_until(frame, handler, "mark", 0.5)
    assert query.stop.called


def test_resume_from_the_stored_mark(spark, tmp_path):
    rows = make(300, 8)
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    batch = lambda part: spark.createDataFrame(part, "symbol string, time bigint, price double").withColumn(
        "digit", Y.last_digit(Y.F.col("price")))
    write(inbox, "0", rows[:100])
    V.run_available(stream(spark, inbox), V.MarkedCollection(spark, out, "a"), str(tmp_path / "lost"))
    again = V.MarkedCollection(spark, out, "b")
    for _ in range(2):
        again.back_fill(batch(rows[50:220] + rows[60:70]))
    write(inbox, "1", rows[180:])
    V.run_available(stream(spark, inbox), again, str(tmp_path / "new"))
    again(batch(rows[180:]), 1)
    got = sorted((r["time"], r["symbol"], r["price"]) for r in again.rows().collect())
    assert got == sorted((t, s, p) for s, t, p in rows)
    assert {r["symbol"]: r["last_time"] for r in again.marks().collect()} == {
        s: max(t for q, t, _ in rows if q == s) for s in ("hot", "a", "b")}


def test_live_state_drops_idle_symbols(spark, tmp_path):
    handler = V.LivePrediction(spark, str(tmp_path / "out"), RULE, idle=50)
    batch = lambda part: spark.createDataFrame(part, "symbol string, time bigint, price double").withColumn(
        "digit", Y.last_digit(Y.F.col("price")))
    handler(batch([("x", t, 1.0 + t) for t in range(5)] + [("y", t, 1.0) for t in range(30, 40)]), 0)
    assert {r["symbol"]: r["ticks"] for r in handler.accuracy().collect()} == {"x": 5, "y": 10}
    handler(batch([("y", t, 2.0) for t in range(60, 90)]), 1)
    assert {r["symbol"]: r["ticks"] for r in handler.accuracy().collect()} == {"y": 40}
    handler(batch([("x", 95, 2.0)]), 2)
    assert {r["symbol"]: r["ticks"] for r in handler.accuracy().collect()} == {"x": 1, "y": 40}
    # One more than the rule needs: the tick before the first delta of the window.
    assert handler.state().where("symbol = 'y'").count() == RULE.prices + 1
