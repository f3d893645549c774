"""Every operator on null and repeated ids, bytes that are not UTF-8, long texts, clashing columns and empty tables."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from kvlog.llm import bpe, html_text, langid, licenses, minhash, mixing, quality, suffix_dedup, topk, warc

RNG = random.Random(11)
WORDS = ["v%d" % i for i in range(400)]
BASE = " ".join(RNG.choice(WORDS) for _ in range(150))
LONG = " ".join(RNG.choice(WORDS) for _ in range(450_000))  # 2 MB
BROKEN = b"caf\xc3 " + BASE.encode() + b"\xff end"
ROWS = [(1, BASE.encode()), (1, BASE.encode()), (1, b"another text of the same id, short"), (None, BASE.encode()), (None, None), (None, b"only without an id " + BASE[:300].encode()), (2, b""), (3, BASE.encode() + b" tail"), (4, BROKEN), (5, b"\xff\xfe"), (6, LONG.encode()), (7, LONG[1000:].encode())]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(i, None if t is None else bytearray(t), "src%d" % (k % 4) if k % 3 else None, "en") for k, (i, t) in enumerate(ROWS)], "doc_id long, raw binary, source string, lang string")
    extra = {c: F.lit("x") for c in ("copy_no", "mix_key", "n_words", "kept", "__q_text", "__row", "__u", "g", "bucket", "id", "component", "row", "digest")}
    return df.withColumn("text", F.col("raw").cast("string")).drop("raw").withColumns(extra).repartition(3).cache()


def counted(rows):
    return collections.Counter(map(str, rows))


def test_quality(docs):
    got = quality.quality_report(docs).collect()
    assert len(got) == len(ROWS) and counted(r["doc_id"] for r in got) == counted(i for i, _ in ROWS)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.where("n_words <> 'x'").isEmpty()


def test_mixing(docs):
    rows = mixing.mix_rows(docs, {"src1": 0.5})
    assert rows.columns == docs.columns and rows.where("copy_no <> 'x' or mix_key <> 'x'").isEmpty()
    assert rows.count() == mixing.mix(docs, {"src1": 0.5}).count()
    first = mixing.mix(docs, {}, scale=30.0).where("doc_id = 1").groupBy(F.xxhash64("text")).agg(F.max("copy_no").alias("n")).collect()
    assert len({r["n"] for r in first}) == 1


def test_language(docs, spark):
    got = langid.identify_held_out(docs).collect()
    assert len(got) == len(ROWS) and all(r["lang_pred"] in ("en", "und") and 0 <= r["score"] <= 1 for r in got)
    held = langid.identify_held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null").select("doc_id", "lang")
    right, n = held.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right >= 0.97


def test_suffix_arrays(docs, monkeypatch):
    for limits in ({}, {"HOT": 0, "GROUP_BYTES": 1 << 20, "SHARD_BYTES": 1 << 18}):
        for k, v in limits.items():
            monkeypatch.setattr(suffix_dedup, k, v)
        rows = [(1 << 62 if i is None else i, t or b"") for i, t in ROWS]
        low = {}
        for i, b in sorted(rows, key=lambda r: r[0]):
            for p in range(len(b) - 49):
                low.setdefault(b[p : p + 50], i)
        want = []
        for i, b in rows:
            gone = np.zeros(len(b) + 1, np.int64)
            for p in range(len(b) - 49):
                if low[b[p : p + 50]] < i:
                    gone[p] += 1
                    gone[p + 50] -= 1
            gone = np.cumsum(gone[:-1]) > 0
            spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
            want.append((None if i == 1 << 62 else i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
        assert counted(tuple(r) for r in suffix_dedup.remove_repeats(docs).collect()) == counted(want)
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.where("g <> 'x'").isEmpty() and left.where("text is null").count() == 1


def test_bpe(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = []
    for i, t in ROWS:
        text = (t or b"").decode("utf-8", "replace")
        ids = encoding.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert counted(tuple(r) for r in bpe.encode_documents(docs, path, public_tokenizers.PATTERN).collect()) == counted(want)


def test_bpe_joins_ordinary_words_and_refuses_open_vocabularies(tmp_path):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.Bpe(bpe.read_ranks(path), public_tokenizers.PATTERN)
    own.encode(" ".join("".join(RNG.choice("abcdefgilmnorstu") for _ in range(12)) for _ in range(50)))
    assert own.joins >= 100
    import base64

    lines = [base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)] + [base64.b64encode(b"abc") + b" 256"]
    (tmp_path / "open.tiktoken").write_bytes(b"\n".join(lines))
    with pytest.raises(ValueError):
        bpe._check(str(tmp_path / "open.tiktoken"))


def test_near_duplicates(docs):
    sets = []
    for i, t in ROWS:
        w = (t or b"").lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                label = [label[b] if v == label[a] else v for v in label]
    want = []
    for k, (i, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if label[j] == label[k] and sets[j][0] is not None] if s else [i]
        c = min([x for x in ids if x is not None], default=i)
        want.append((i, len(s), c, c == i))
    assert counted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == counted(want)


def test_licenses(docs):
    got = licenses.scan(docs).collect()
    assert len(got) == len(ROWS)
    twice = docs.limit(1).select(licenses.canonical(F.lit("Licence licence COLOUR colour")).alias("c")).first()["c"]
    assert twice == "license license color color"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>x</p>" * 200
    rows = [(1, "http://a/\tb", big), (1, "http://a/\tb", big), (2, "", big), (9, "u v\x01", big), (None, "n", big), (None, None, None), (3, "http://c", "<div>" * 50_000 + "deep"), (4, "d", "caf\xe9"), (5, "t\tt", big + "y"), (6, None, big + "y")]
    df = spark.createDataFrame([(i, u, None if h is None else bytearray(h.encode("latin-1"))) for i, u, h in rows], "page_id long, url string, raw binary")
    return df.withColumn("html", F.col("raw").cast("string")).drop("raw").withColumns({c: F.lit("x") for c in ("text", "rid", "uri", "winner", "payload", "sha256")}).cache()


def test_html(pages):
    got = html_text.extract(pages).collect()
    assert len(got) == 10
    text = {r["page_id"]: r["text"] for r in got if r["page_id"] is not None}
    assert text[3] == "deep" and text[4] == "caf�" and text[1].split() == ["x"] * 200
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_visibility():
    text = html_text.page_text
    assert text("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>") == "yes"
    assert text("<details><summary>s</summary>no</details>") == "s" and text("<details open><summary>s</summary>yes</details>") == "s\nyes"
    assert text("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"
    assert text("<ol><li value=5>a<li>b</ol>") == "5. a\n6. b"
    assert text("<object>kept</object> <input type=submit value=Go><input value=no>") == "kept Go"
    css = "<style>/* p{display:none} */ .x,i.v{display:none} #q{visibility:hidden} @media print{b{display:none}} .y{color:red}</style>"
    assert text(css + "<p class='a x'>no</p><p id=q>no</p><p class=y>yes <i class=v>no</i><b>too</b>") == "yes too"


def test_archives(pages, spark, tmp_path):
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(got) == 10
    names = {r["record_id"] for r in got}
    revisits = [r for r in got if r["record_type"] == "revisit"]
    assert revisits and all(r["refers_to_id"] in names for r in revisits)
    assert {(r["page_id"], r["refers_to"]) for r in revisits} == {(1, 9), (2, 9), (None, 9), (5, 6)}


def test_arc_files_to_archives(spark, tmp_path):
    records = [{"url": "http://a b", "payload": b"GIF\xff" * 400, "type": "image/gif", "date": "20010203040506"}, {"url": "http://c", "payload": b"GIF\xff" * 400}]
    (tmp_path / "in").mkdir()
    for v in ("1", "2"):
        (tmp_path / "in" / f"{v}.arc").write_bytes(warc.write_arc(records, v))
    rows = warc.arc_pages(spark, str(tmp_path / "in"))
    assert counted((r["url"], r["type"], r["date"]) for r in rows.collect()) == counted([("http://a%20b", "image/gif", "2001-02-03T04:05:06Z"), ("http://c", "text/html", "1970-01-01T00:00:00Z")] * 2)
    warc.write_archives(rows, str(tmp_path / "out"))
    got = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted(r["record_type"] for r in got) == ["response"] + ["revisit"] * 3 and {r["payload_bytes"] for r in got} == {1600}


def test_top_k_repeats_and_huge_values(spark):
    import duckdb

    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(50, [0.5] * 4), (50, [0.5] * 4), (7, [0.25] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    got = topk.top_k(df, df.where("vec_id % 50 = 0")).select("query_id", "rank", "vec_id", "score").collect()
    assert counted(tuple(r) for r in got) == counted(con.execute(topk.ORACLE).fetchall())
    df = spark.createDataFrame([(0, [1e300, 1e17]), (1, [1.0, 1.0]), (2, [-1e300, 0.0]), (3, [1e14, 0.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    top = (1 << 63) - 1
    assert got == [(1, top), (3, top), (2, -top - 1)]
