from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quaystone.functions.mailids import message_key, message_keys, path_key
from quaystone.operators import deliveries

SCHEMA = "delivery_id long, received_at timestamp, message_id string, source_path string, _file string, _surplus string, body_text string"
T0 = datetime(2025, 1, 1)


def _rows():
    rows = []
    for i in range(200):
        key = None if i % 17 == 0 else "hot@H.example" if i % 3 == 0 else f"m{i % 40}@h.example"
        raw = None if key is None else [key, f"<{key}>", f" <{key}>\r\n", key.replace("h.example", "H.Example")][i % 4]
        rows.append((i, T0 + timedelta(hours=i * 7 % 50) if i % 11 else None, raw, f"inbox/b/{i}.eml", "x", "y", "z" * (i % 5)))
    return rows


def _brute(rows):
    groups = defaultdict(list)
    for r in rows:
        if r[2]:
            k = r[2].strip().strip("<>")
            groups[k.split("@")[0] + "@" + k.split("@")[1].lower()].append((r[1] is None, r[1] or T0, r[0]))
    return {x[2] for g in groups.values() for x in sorted(g)[1:]}


@pytest.mark.parametrize("limit", [deliveries.BROADCAST_BYTES, 0])
def test_surplus_equals_brute_force_on_both_ways_of_applying_vectors(stored, limit, monkeypatch):
    monkeypatch.setattr(deliveries.mark, "__defaults__", (limit,))
    rows = _rows()
    m = stored(rows, SCHEMA, files=5)
    got = {r.delivery_id for r in deliveries.deliveries_marked(m, ["delivery_id"]).where("_surplus").collect()}
    assert got == _brute(rows)


def test_kept_rows_are_whole_and_keep_clashing_columns(stored):
    m = stored(_rows(), SCHEMA)
    kept = deliveries.kept_messages(m)
    assert kept.columns == m.columns
    assert kept.count() == 200 - len(_brute(_rows()))


def test_rows_alike_in_everything_leave_one(stored):
    m = stored([(1, T0, "a@b", "p", None, None, None)] * 6, SCHEMA, files=3)
    assert deliveries.kept_messages(m).count() == 1


def test_empty_table_and_table_without_files(spark, stored):
    assert deliveries.kept_messages(stored([], SCHEMA)).count() == 0
    assert deliveries.kept_messages(spark.createDataFrame(_rows(), SCHEMA)).count() == 200 - len(_brute(_rows()))


def test_attachments_follow_their_delivery(stored):
    m = stored([(1, T0, "a@b", "inbox/x/1.eml", None, None, None), (2, T0, "<a@B>", "inbox/x/2.eml", None, None, None)], SCHEMA)
    o = stored([(1, "inbox\\x\\2.eml"), (2, "./inbox//x/2.eml"), (3, "inbox/x/1.eml"), (4, None), (5, "INBOX/x/2.eml")], "occ_id long, message_source string", "o")
    assert {tuple(r) for r in deliveries.surplus_rows(m, o).collect()} == {("messages", 2), ("occurrences", 1), ("occurrences", 2)}


def test_forms_of_ids_and_paths(spark):
    df = spark.createDataFrame([("\t<Ab@C.D>\r\n", "a\\b//c", ["<x@Y> <z@W>", " ", None, "<p@q><r@S>"])], "i string, p string, r array<string>")
    r = df.select(message_key(F.col("i")).alias("i"), path_key(F.col("p")).alias("p"), message_keys(F.col("r")).alias("r")).first()
    assert (r.i, r.p, r.r) == ("Ab@c.d", "a/b/c", ["x@y", "z@w", "p@q", "r@s"])
    assert spark.createDataFrame([("<>",), (" ",), (None,)], "i string").select(message_key(F.col("i")).alias("k")).where("k is not null").count() == 0


def test_vectors_that_python_cannot_read_are_joined(spark, stored, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(deliveries, "_readable", lambda uri, files: False)
    rows = [(i, f"<{i % 5}@h>", i) for i in range(40)]
    df = stored(rows, "delivery_id long, message_id string, received_at long", files=3)
    placed = deliveries.with_position(df, df.columns)
    lost = deliveries.surplus_positions(placed, F.col("_payload.message_id"), [F.col("_payload.received_at")])
    kept = deliveries.mark(placed, lost, broadcast_bytes=0).where("not _surplus")
    assert sorted(r.d for r in kept.select(F.col("_payload.delivery_id").alias("d")).collect()) == [0, 1, 2, 3, 4]
