"""Every operator over odd rows and over an empty table: the results that the docstrings state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontam, langid, licenses, lines, media, mixing, neardup, quality, secrets, substrings


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_mixing(odd_docs, no_docs):
    out = mixing.mix(odd_docs).collect()
    assert len(out) == 9 and all(r["taken"] <= 3 * r["size"] for r in out)
    assert by_id(mixing.mix(odd_docs))[2]["taken"] == 0
    assert mixing.mix(no_docs).count() == 0


def test_lines(odd_docs, no_docs):
    out = lines.remove_boilerplate(odd_docs, min_sites=2)
    got = by_id(out)
    assert out.count() == 9 and out.columns == [*odd_docs.columns, "n_lines", "n_removed", "mirrored"]
    assert got[2]["text"] is None and got[2]["n_lines"] == 0 and got[3]["text"] == ""
    assert got[1]["n_removed"] == 0  # source a only: a null site counts for no line
    assert lines.remove_boilerplate(no_docs).count() == 0


def test_quality(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, 1, 0), (7, 0, 0), (8, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, labels)
    out = quality.score(odd_docs, model).collect()
    assert len(out) == 9 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert quality.fit(odd_docs, labels.limit(0)) is None
    assert {r["score"] for r in quality.score(odd_docs, None).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0
    assert quality.keep_good(odd_docs, None).count() == 9 and quality.keep_good(no_docs, model).columns == no_docs.columns


def test_langid(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    got = by_id(langid.predict(odd_docs, model))
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[8]["lang_pred"] == "und" and got[2]["score"] == 0
    assert got[5]["lang_pred"] == "en" and len(got) == 8
    assert by_id(langid.predict(odd_docs, langid.fit(no_docs)))[5]["lang_pred"] == "und"


def test_licenses(odd_docs, no_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0 and licenses.scan_licenses(no_docs).count() == 0


def test_substrings(odd_docs, no_docs):
    got = substrings.repeated_spans(odd_docs).collect()
    assert got == []  # the only repeated text belongs to one id and to a null id
    assert substrings.repeated_spans(no_docs).count() == 0
    assert substrings.drop_repeats(odd_docs).count() == 9


def test_neardup(odd_docs, no_docs):
    out = neardup.near_duplicates(odd_docs)
    got = by_id(out)
    assert out.count() == 9
    assert got[7]["component_id"] == 1 and not got[7]["kept"] and got[1]["kept"]
    assert got[2]["n_shingles"] == got[3]["n_shingles"] == got[6]["n_shingles"] == 0 and got[3]["kept"]
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert neardup.near_duplicates(no_docs).count() == 0
    assert sorted(r["doc_id"] or 0 for r in neardup.keep_one(odd_docs).collect()) == [0, 1, 1, 2, 3, 5, 6, 8]


def test_decontam(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "three FOUR five"), (2, None), (None, "six seven"), (3, "!!"), (4, "nine"), (1, "three FOUR five")], "item_id long, text string")
    got = by_id(decontam.contamination(odd_docs, items))
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"], got[1]["contaminated"]) == (10, 6, ["1", "4", None], True)
    assert got[None]["n_hit"] == 6 and got[2]["n_words"] == 0 and not got[2]["contaminated"]
    unnamed = spark.createDataFrame([(None, "six seven"), (9, "seven eight")], "item_id long, text string")
    assert (by_id(decontam.contamination(odd_docs, unnamed))[1]["n_hit"], by_id(decontam.contamination(odd_docs, unnamed))[1]["items"]) == (3, ["9", None])
    rows = spark.createDataFrame([(2, "three four five"), (2, "quite another text"), (None, "three four five"), (None, None), (3, "x three four five " + "y " * 4)], "doc_id long, text string")
    left = decontam.drop_contaminated(rows, items, hit_share=0.4).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == [(0, ""), (2, "quite another text"), (3, "x three four five " + "y " * 4)]
    assert decontam.contamination(odd_docs, items.limit(0)).filter("contaminated OR n_hit > 0").count() == 0
    assert decontam.contamination(no_docs, items).count() == 0
    assert decontam.drop_contaminated(odd_docs, items).columns == odd_docs.columns


def test_media(odd_docs, no_docs):
    out = media.describe(media.store(odd_docs))
    got = by_id(out)
    assert out.count() == 9 and got[2]["n_bytes"] == 0 and got[2]["payload_bytes"] == 576
    assert got[2]["media_sha256"] == got[3]["media_sha256"]
    assert media.describe(media.store(no_docs)).count() == 0


def test_secrets(odd_docs, no_docs):
    out = secrets.scan_spans(odd_docs)
    assert out.count() == 9 and out.filter(F.size("found") > 0).count() == 0
    assert secrets.scan_spans(no_docs).count() == 0


def test_training_reads_whole_texts_and_every_language(spark):
    pad = "same words here " * 13_000
    rows = [(i, pad + ("GOOD! " if i % 2 else "bad ") * 20_000) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    got = by_id(quality.score(df, quality.fit(df, labels, steps=40)))
    assert min(got[i]["score"] for i in range(1, 12, 2)) > max(got[i]["score"] for i in range(0, 12, 2)) + 0.5
    langs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(300)], "doc_id long, text string, lang string")
    assert len(langid.fit(langs).content) == 300
    # What only the end of a long text, or the last texts of a language, show is learnt too.
    ends = spark.createDataFrame([(i, "lorem ipsum dolor sit " * 2000 + f"zebra{i} quagga okapi " * 1000, "a") for i in range(90)], "doc_id long, text string, lang string")
    content = langid.fit(ends).content["a"]
    assert all(f"zebra{i}".encode() in content for i in range(90)) and len(content) <= 98304 + 90


def test_equal_sums_go_to_the_first_language(spark):
    model = langid.Dictionaries({"b": b"the same words here", "a": b"the same words here"})
    got = by_id(langid.predict(spark.createDataFrame([(1, "the same words")], "doc_id long, text string"), model))[1]
    assert got["lang_pred"] == "a" and got["margin"] == 0 and got["rejected"]


def test_equal_passages_go_to_the_shortest_then_the_first(spark):
    text = "all rights reserved x all rights all rights reserved y all rights reserved"
    df = spark.createDataFrame([(None, text), (None, text), (1, None)], "doc_id long, text string")
    got = [(r["doc_id"], r["dice"], r["first_word"], r["n_words"]) for r in licenses.scan_licenses(df).collect()]
    assert got == [(None, 1.0, 0, 3)] * 2


def test_real_hits_among_odd_rows(spark):
    key = "token=abcdef123456"
    df = spark.createDataFrame([(None, key), (None, key), (1, key + " " + key), (1, None)], "doc_id long, found string").withColumnRenamed("found", "text").withColumn("found", F.lit(1))
    got = sorted((r["doc_id"] or 0, len(r["found"])) for r in secrets.scan_spans(df).collect())
    assert got == [(0, 1), (0, 1), (1, 0), (1, 2)]
    long = " ".join(f"word{i % 89}x{i % 97}" for i in range(120))
    docs = spark.createDataFrame([(1, f"a {long}"), (1, f"a {long}"), (2, f"b {long} c"), (2, None), (None, long), (3, "")], "doc_id long, text string").withColumns({"k": F.lit("k"), "start": F.lit(1)})
    spans = substrings.repeated_spans(docs).collect()
    assert {(r["doc_id"], r["first_doc_id"], r["kept"]) for r in spans} == {(1, 1, True), (2, 1, False)}
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in substrings.drop_repeats(docs).collect())
    assert [x[0] for x in left] == [0, 1, 1, 2, 2, 3] and len(left[4][1]) < 60 and left[0][1] == long


def test_flat_and_damaged_images(spark):
    import numpy as np

    assert media.cosine_hash(np.full((24, 24), 255, np.uint8)) == "0" * 16
    whole = media.encode_png(b"abc" * 192)
    rows = spark.createDataFrame([(1, 576, bytearray(whole)), (2, 576, bytearray(whole[:-3])), (3, 0, None)], "doc_id long, n_bytes long, media binary")
    got = by_id(media.describe(rows))
    assert got[1]["damage"] is None and got[1]["payload_bytes"] == 576
    assert all(got[i]["payload_sha256"] is None and got[i]["feature"] is None and got[i]["damage"] for i in (2, 3))


def test_site_columns_with_clashing_names(spark):
    banner = "a banner line on all of the sites"
    rows = [(i, f"{banner}\nbody {i}", f"s{i}", 7, 8, "x") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, n_removed int, mirrored string")
    got = lines.remove_boilerplate(df).collect()
    assert {(r["n_lines"], r["n_removed"], r["mirrored"], r["text"].split()[0]) for r in got} == {(2, 1, False, "body")}


def test_filters_over_odd_rows(odd_docs, no_docs, spark):
    rows = odd_docs.withColumns({"__k1": F.lit(1), "node": F.lit("n")})
    items = spark.createDataFrame([(1, "two three four five six seven")], "item_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in decontam.drop_contaminated(rows.drop("__k1"), items).collect()) == [2, 3, 5, 6, 8]
    assert decontam.drop_contaminated(no_docs, items).count() == 0 and neardup.keep_one(no_docs).count() == 0 and substrings.drop_repeats(no_docs).count() == 0
    assert neardup.keep_one(rows).columns == rows.columns


def test_pipeline_stages_over_odd_rows(odd_docs, no_docs, spark, tmp_path):
    import corpus_pipeline as cp

    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "quite another set of words"), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    clash = odd_docs.withColumns({"copies": F.lit(1), "rate": F.lit(0.5), "target": F.lit("t"), "taken": F.lit(3), "mirrored": F.lit(True)})
    for name, stage in cp.STAGES:
        out = stage(spark, clash, sf)
        got = out.collect()
        ids = sorted(r["doc_id"] or 0 for r in got)
        if name == "near_dedup":
            assert ids == [0, 1, 1, 2, 3, 5, 6, 8]
        elif name in ("line_dedup", "decontamination"):
            assert ids == [0, 1, 1, 2, 3, 5, 6, 7, 8]
        elif name == "mixing":
            assert {"copies", "size"} <= set(out.columns) and all(r["copies"] > 0 for r in got)
        assert stage(spark, no_docs, sf).count() == 0


def grey_png(height, width, body=None, header=None):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0) if header is None else header
    raw = b"".join(b"\0" + bytes((r * width + c) * 7 % 256 for c in range(width)) for r in range(height)) if body is None else body
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_of_any_size_and_malformed_ones_give_rows(spark):
    good = [(h, w) for h in (1, 7, 24, 25, 48, 100) for w in (1, 23, 24, 48)]
    bad = [grey_png(0, 24), grey_png(24, 0), grey_png(2, 2, header=b"\1\2\3"), grey_png(2, 2, body=b"\0" * 5), grey_png(2, 2, body=b"\0" * 10**7), b"", None]
    rows = [(i, 1, grey_png(h, w)) for i, (h, w) in enumerate(good)] + [(100 + i, 1, b) for i, b in enumerate(bad)]
    got = {r["doc_id"]: r for r in media.describe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert len(got) == len(rows)
    for i, (h, w) in enumerate(good):
        assert got[i]["damage"] is None and got[i]["payload_bytes"] == h * w and len(got[i]["feature"]) == 16
    assert all(got[100 + i]["damage"] and got[100 + i]["feature"] is None for i in range(len(bad)))


def test_cells_are_means_of_equal_areas():
    rng = np.random.default_rng(1)
    for n in (1, 5, 24, 36, 48, 50):
        x = rng.integers(0, 256, (n, 3)).astype(float)
        fine = np.repeat(x, media.SIDE, axis=0).reshape(media.SIDE, n, 3).mean(axis=1)
        assert np.allclose(media._cells(x, 0), fine)


@pytest.mark.parametrize("kind", ["string", "long"])
def test_near_duplicates_take_any_id(spark, kind):
    words = [f"w{i}" for i in range(60)]
    name = (lambda i: f"doc-{i:03d}") if kind == "string" else (lambda i: -(2**63) + i)
    rows = [(name(i), " ".join(words[: 55 + i % 5] + [f"own{i % 3}"])) for i in range(30)] + [(name(40), "nothing like it at all here")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string")).collect()}
    assert got == {name(i): name(0) for i in range(30)} | {name(40): name(40)}


def test_a_text_of_many_lines_that_all_repeat(spark):
    from time import time

    shared = [f"shared line number {i}" for i in range(12_000)]
    rows = [(s, f"own {s}\n" + "\n".join(shared) + f"\nMenu\nlast {s}", f"site{s}") for s in range(12)]
    began = time()
    got = lines.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert time() - began < 60
    assert all(r["text"] == f"own {r['doc_id']}\nMenu\nlast {r['doc_id']}" and r["n_removed"] == 12_000 for r in got)
