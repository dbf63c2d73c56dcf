"""BPE against the tokenizers library; the filter and divergence audits against brute force; odd input of all three."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from marlstone.llm import bpe, divergence, filter_audit

public = pytest.importorskip("public_tokenizers")
FILE = public.path("byte_bpe_50k.json")
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def own():
    return bpe.load_tokenizer(FILE)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(FILE)


def test_bpe_gives_the_ids_of_the_library(own, library):
    rnd = random.Random(3)
    late = [chr(c) for pair in bpe.LATE_LETTERS + bpe.LATE_NUMBERS for c in pair]
    pool = [*late[:40], *"abcABC  \n\t\x0b\x1c\x85\xa0　'sdlrevm129!?.é中ß€😀", "<|endoftext|>", "<|endof", "'ll"]
    texts = ["".join(rnd.choices(pool, k=rnd.randrange(30))) for _ in range(3000)]
    texts += ["".join(rnd.choices("abcdefgh", k=n)) for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 700)] + ["=" * 40_000, " " * 999 + "x", "the" * 5000]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want
        rnd.shuffle(want)
        assert own.decode(want[::2]) == library.decode(want[::2], skip_special_tokens=False)


def test_bpe_splits_every_character_as_the_library_does(own):
    pre = pytest.importorskip("tokenizers").pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    points = [p for a, b in bpe.LATE_LETTERS + bpe.LATE_NUMBERS for p in (a, b, a - 1, b + 1)] + list(range(0, 0x3000)) + list(range(0x3000, 0x110000, 211))
    for p in points:
        if not 0xD800 <= p < 0xE000:
            text = "".join(head + chr(p) + tail for head in "a1! " for tail in ("b", "2", "?", " "))
            assert own.pieces(text) == [text[i:j] for _, (i, j) in pre.pre_tokenize_str(text)], hex(p)


def test_bpe_keeps_a_bounded_cache(own, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 10)
    words = [f"zq{i}" for i in range(60)]
    assert [own.encode(w) for w in words] == [own._scan([own.byte_ids[b] for b in w.encode()]) for w in words]
    own["zz"], own["zy"]
    assert len(own) <= 10


def test_bpe_refuses_what_it_does_not_build(tmp_path):
    import json

    with open(FILE) as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.load_tokenizer(str(tmp_path / "t.json"))


def test_bpe_of_odd_rows(spark, odd_docs, no_docs, own, library):
    coded = bpe.decode(bpe.encode(odd_docs.withColumn("ids", F.lit("clash")), own), own)
    got = sorted(((r.doc_id, list(r.ids), r.text) for r in coded.collect()), key=repr)
    want = sorted(((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in odd_docs.collect()), key=repr)
    assert got == want
    assert bpe.encode(no_docs, own).count() == 0
    missing = spark.createDataFrame([(1, [50256, 99999999, -5, None, 64]), (None, None), (2, []), (3, [0, 134, 64, 127])], "doc_id long, ids array<int>")
    assert {(r.doc_id, r.text) for r in bpe.decode(missing, own).collect()} == {(1, "<|endoftext|>a"), (None, ""), (2, ""), (3, library.decode([0, 134, 64, 127], skip_special_tokens=False))}


def audit_by_hand(rows, labels):
    known = [x for x in labels if x[0] is not None]
    good, toxic = {i for i, q, _ in known if q == 1}, {i for i, _, t in known if t == 1}
    failed = []
    for i, text, part in rows:
        text = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = [len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text))]
        tests.append(i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows))
        failed.append((part or "", i, {c for c, t in zip("ABCDE", tests) if t}))
    out, by_filter = {}, Counter()
    for part in {p for p, _, _ in failed}:
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                mine = [(i, f, bool(f & set(order[: step - 1]))) for p, i, f in failed if p == part]
                gone = [i for i, f, early in mine if letter in f and not early]
                by_filter[part, letter] += len(gone)
                out[part, "".join(order), step] = (sum(not early and letter not in f for _, f, early in mine), len(gone), sum(letter in f and early for _, f, early in mine), sum(f == {letter} for _, f, _ in mine), sum(i in good for i in gone), sum(i in toxic for i in gone))
    return {k: (*v, by_filter[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_equals_brute_force(spark):
    rnd = random.Random(11)
    texts = [" ".join(rnd.choices(["Alpha", "b#", "gam", "de\tlta", "EPS", "é"] + [f"w{i}" for i in range(rnd.choice([3, 80]))], k=rnd.choice([0, 5, 49, 50, 70, 200]))) for _ in range(60)] + [None, "", " \n"]
    rows = [(rnd.choice([None, *range(90)]), rnd.choice(texts), rnd.choice(["a", "a", "b", None, ""])) for _ in range(300)]
    rows += rows[:20]
    labels = [(rnd.randrange(90), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(80)] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[F.lit("clash").alias(c) for c in ("part", "failed", "n", "task", "words", "good", "__k1")])
    got = filter_audit.audit(docs.repartition(5), spark.createDataFrame(labels, LABELS))
    assert {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in got.collect()} == audit_by_hand(rows, labels)


def test_filter_audit_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 1), (3, 0, 1)], LABELS)
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(odd_docs, labels).collect()}
    assert got == audit_by_hand([(r.doc_id, r.text, r.source) for r in odd_docs.collect()], [(r.doc_id, r.quality, r.toxic) for r in labels.collect()])
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert filter_audit.audit(odd_docs, labels.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0


def test_a_hot_copy_and_a_hot_row_are_spread(spark):
    """A third of the rows share a text under different ids, another third are one repeated row."""
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text, "s") for i in range(7000)] + [(9000, text + " once more", "s")] * 7000 + [(10_000 + i, f"{text} {i}", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    failed = Counter()
    for r in filter_audit.failing(docs).collect():
        failed[r.failed] += r.n
    assert failed == {0: 1 + 7000 + 200, 16: 6999}


def divergence_by_hand(rows, min_docs, top):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(fold))
        docs[lang].update(set(terms))
        n[lang, source].update(terms)
    out = []
    for lang, source in list(n):
        kept = [t for t, c in docs[lang].items() if c >= min_docs]
        sources = [s for x, s in n if x == lang]
        whole = sum((n[lang, s] for s in sources), Counter())

        def p(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        mine, all_ = p(n[lang, source]), p(whole)
        pairs = [(-sum(abs(mine[t] - other[t]) for t in kept), s.encode(), s) for s in sources if s != source for other in [p(n[lang, s])]]
        terms = [(all_[t] - mine[t], t.encode(), t) for t in kept if n[lang, source][t] > 0 and mine[t] > all_[t]]
        out += [(lang, source, "pair", s, -v, i) for i, (v, _, s) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def test_divergence_equals_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = [f"t{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)] + ["ÉTÉ", "été", "Ab", "ab", "中"]
    rows = []
    for _ in range(600):
        lang, source = rnd.choice(["en", "en", "de", None, "zz"]), rnd.choice(["s1", "s2", "s3", "é", "z", None, ""])
        bias = vocabulary[: 5 + 7 * (ord(source[0]) % 3)] if source else vocabulary
        rows.append((None if lang == "zz" and rnd.random() < 0.5 else " 1,".join(rnd.choices(bias, k=rnd.randrange(12))), lang, source))
    rows += [("", "empty", "x"), (None, "empty", "y"), ("once only", "rare", "x")] + rows[:30]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").select("*", *[F.lit(3).alias(c) for c in ("term", "n", "value", "item", "rank", "total")])
    got = divergence.divergence(docs.repartition(4), min_docs=8, top=7)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows, 8, 7)


def test_divergence_of_odd_rows(odd_docs, no_docs):
    got = sorted(map(tuple, divergence.divergence(odd_docs, min_docs=2).collect()))
    assert got == divergence_by_hand([(r.text, r.lang, r.source) for r in odd_docs.collect()], 2, 50)
    assert divergence.divergence(no_docs).count() == 0


def test_shares_are_exact_for_huge_counts(spark):
    rows = [(c, c + d, v) for c in (0, 1, 10**9, 10**15, 7 * 10**17) for d in (0, 3, 10**17) for v in (1, 999)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("*", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v) for r in got)
