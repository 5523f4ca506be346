from __future__ import annotations

import json

from segloom.streaming import inbox


def test_what_comes_in_is_counted_once(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    write = lambda n, rows: (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    write("a", [{"doc_id": 1, "text": "Hello\n质量报告", "source": "s"}, {"doc_id": 2, "text": "12", "source": "s"}])
    for _ in range(2):
        inbox.each_batch(inbox.lines(spark, folder), inbox.gated_counts("English", out), state).awaitTermination()
    write("b", [{"doc_id": 3, "text": "World", "source": "s"}])
    inbox.each_batch(inbox.lines(spark, folder), inbox.gated_counts("English", out), state).awaitTermination()
    rows = spark.read.parquet(out)
    assert rows.selectExpr("sum(total)", "sum(translated)", "sum(not_source_language)", "sum(untranslatable)").first()[:] == (4, 2, 1, 1)
