"""Each stage of the pipeline on what the stage before it kept, against plain versions."""

from __future__ import annotations

import corpus_pipeline as cp
from barloom.llm import common
from barloom.llm.common import table, written
from brute import near, without_repeats
from test_operators import exact, packing_is_right


def test_stages(spark, sf):
    docs, kept = table(spark, sf, "documents"), []
    columns = docs.columns
    for name, stage in cp.STAGES:
        docs = written(stage(spark, docs, sf), name)
        kept.append([(r["doc_id"], r["text"]) for r in docs.collect()] if "text" in docs.columns else docs.collect())
        assert name == "packing" or docs.columns == columns
    clean, unique, apart, trimmed, packed = kept
    ids = lambda rows: sorted(i for i, _ in rows)
    assert ids(unique) == sorted(i for i, w in exact(clean).items() if w[2])
    assert ids(apart) == sorted(i for i, (_, c) in near(dict(unique)).items() if i == c)
    assert dict(trimmed) == {i: dict(apart)[i] and w[3].decode(errors="ignore") for i, w in without_repeats(apart).items()}
    packing_is_right(packed, trimmed)
    assert sorted(r["ids_crc32"] for r in cp.run(spark, sf).collect()) == sorted(r["ids_crc32"] for r in packed)


def odd_table(spark, tmp_path, rows, extra="x"):
    """Documents with clashing columns, beside labels, in a folder of their own."""
    docs = spark.createDataFrame([(i, t, extra, extra, 1, extra) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, bucket string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs.columns


def test_odd_tables(spark, tmp_path):
    """Null, empty and repeated texts, null and repeated identifiers, clashing columns: only copies go."""
    long = " ".join(f"word{k}" for k in range(60))
    rows = [(20, long), (21, long), (21, long), (22, long + " more"), (23, None), (24, ""), (25, "  \n"), (None, "no id here"), (None, None), (26, "a clean text"), (26, "another text of the same identifier"), (27, "é" * 300)]
    columns = odd_table(spark, tmp_path, rows)
    docs, kept = table(spark, str(tmp_path), "documents"), []
    for name, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        kept.append({(r["doc_id"], r["text"]) for r in docs.collect()})
    assert kept[0] == set(rows)  # labels without both classes among these: nothing is toxic
    assert kept[1] == {(20, long), (22, long + " more"), (23, None), (25, "  \n"), (None, "no id here"), (26, "a clean text"), (26, "another text of the same identifier"), (27, "é" * 300)}
    assert kept[2] == kept[1] - {(22, long + " more")}
    assert {i for i, _ in kept[3]} == {i for i, _ in kept[2]} and (23, None) in kept[3]
    packed = cp.run(spark, str(tmp_path)).collect()
    assert len(packed) == len(kept[3])


def test_empty_table(spark, tmp_path):
    odd_table(spark, tmp_path, [])
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_stages_remove_tables_of_earlier_ones(spark, tmp_path):
    odd_table(spark, tmp_path, [(i, f"text {i} " * 30) for i in range(30)])
    before = common.made()
    docs = written(cp.drop_copies(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)), "exact")
    assert len(common.made() - before) > 3
    common.sweep_before(docs)
    left = common.made() - before
    assert len(left) == 1 and docs.count() == 30
