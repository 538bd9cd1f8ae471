from __future__ import annotations

import base64
import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lodestrata.llm import exact_dedup as E
from lodestrata.llm.chat_format import format_chats
from lodestrata.llm.common import durable
from lodestrata.llm.exact_dedup import drop_exact_copies, exact_dedup
from lodestrata.llm.warc import archive_pages, normalise, parse_records, read_archives, read_sidecar, write_pages

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile("[\x20\x09-\x0d]")


def plain_dedup(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d is None, d or 0, d))
    return Counter(
        (d, min(own)[3], len(own), hashlib.sha256(bare.encode()).hexdigest()) for bare, own in groups.items() for *_, d in own
    ), {bare: min(own)[3] for bare, own in groups.items()}


@pytest.mark.parametrize("block", [3, 4096])
def test_exact_dedup(spark, block):
    rng = random.Random(block)
    base = ["".join(rng.choice("ab é\n😀") for _ in range(rng.randrange(0, 40))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate([None, "", " \t", "x " * 5000, "x" * 5000, *(rng.choice(base) for _ in range(80))])]
    rows += [(None, base[0]), (None, base[0]), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(d, t, "k", "bare", 1) for d, t in rows], DOCS)
    got = exact_dedup(docs, block_bytes=block).collect()
    expected, keep = plain_dedup(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(keep)
    assert exact_dedup(docs.limit(0)).count() == 0
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert Counter(r.doc_id for r in left.collect()) == Counter(keep.values())


def test_names_are_places_however_the_data_is_dealt(spark):
    pairs = [(i * 7 % 50, i) for i in range(200)]
    expected = {p: n for n, p in enumerate(sorted(pairs))}
    for parts in (1, 3, 9):
        named = E._named(spark.createDataFrame(pairs, "a long, b long").repartition(parts), "t", "a", "b")
        assert {(r.a, r.b): r.name for r in named.collect()} == expected


def test_colliding_hash_is_noticed(spark, monkeypatch):
    honest = E._block_keys

    def weak(seed):
        from pyspark.sql import functions as F

        return honest(seed) if seed else lambda b: F.struct((F.xxhash64(b) % 2).alias("h1"), F.lit(0).cast("long").alias("h2"))

    monkeypatch.setattr(E, "_block_keys", weak)
    docs = spark.createDataFrame([(i, f"text {i % 6}") for i in range(12)], "doc_id long, text string")
    assert Counter(r.group_size for r in E.exact_dedup(docs).collect()) == {2: 12}


def test_chat_snapshots_collapse(spark):
    turns = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user", "a"), (3, 1, "assistant", "B"),
        (4, 5, "user", "a"), (4, 9, "assistant", "b"), (4, 10, "user", "c"), (4, 10, "user", "c"), (5, 0, None, "a"), (6, 0, "user", None), (None, 0, "user", "z"), (7, None, "user", "n"), (7, 1, "user", "m"),
    ]
    got = {r.conv_id: (r.n_turns, r.n_merged, r.rendered) for r in format_chats(spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, chain string")).collect()}
    assert set(got) == {2, 3, 6, 7, None}
    assert got[2] == (3, 2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")
    assert got[6][2] == "<|im_start|>user\n<|im_end|>\n" and got[7][2].startswith("<|im_start|>user\nn")
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def plain_chats(rows):
    """Counter of (conv_id, n_turns, n_merged, rendered) by comparing every prefix."""
    own = defaultdict(set)
    for conv, turn, role, text in rows:
        own[conv].add((turn is not None, turn or 0, role or "user", text or ""))
    body = {c: tuple((r, t) for *_, r, t in sorted(lines)) for c, lines in own.items()}
    inner = {b[:n] for b in body.values() for n in range(1, len(b))}
    groups = defaultdict(list)
    for c, b in body.items():
        groups[b].append((c is None, c))
    return Counter((min(g)[1], len(b), len(g), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in b)) for b, g in groups.items() if b not in inner)


def test_chats_match_brute_force(spark):
    rng = random.Random(9)
    long = [("user" if i % 2 else "assistant", f"line {i % 7}") for i in range(1500)]
    rows = []
    for conv, n in ((1, 1500), (2, 1499), (3, 257), (4, 256), (5, 1)):
        rows += [(conv, i, *t) for i, t in enumerate(long[:n])]
    for conv in [*range(10, 90), None]:
        for turn in range(rng.randrange(1, 6)):
            for _ in range(rng.choice([1, 1, 1, 2, 3])):  # ties and repeated turns
                rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", None, "system"]), rng.choice(["a", "", None, "a<|im_end|>"])))
    rows += rng.sample(rows, 60)
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5))
    assert Counter(tuple(r) for r in got.collect()) == plain_chats(rows)


def test_chats_are_rendered_after_the_anti_join(spark):
    chats = format_chats(spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn int, role string, text string"))
    plan = chats._jdf.queryExecution().optimizedPlan().toString().split("\n")
    rendering = next(i for i, line in enumerate(plan) if "concat_ws" in line)
    anti = next(i for i, line in enumerate(plan) if "LeftAnti" in line)
    assert rendering < anti and not any("im_start" in line for line in plan[anti:])


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    bodies = [None, "", "é" * 50, "<p>" + "x" * 70_000, *("".join(rng.choice("ab<>\r\n") for _ in range(rng.randrange(1, 30))) for _ in range(30))]
    rows = [(i, f"http://x/{i}\r\nX: y", rng.choice(bodies), "k") for i in range(200)] + [(None, None, bodies[2], "k"), (7, "u", "seven", "k"), (7, "u", "seven", "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    largest = {}
    for p, _, h, _ in rows:
        if p is not None:
            largest[h or ""] = max(p, largest.get(h or "", p))
    expected = Counter()
    for p, _, h, _ in rows:
        data, top = (h or "").encode(), largest[h or ""]
        expected[p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if p == top else "revisit", None if p == top else top] += 1
    assert Counter(tuple(r) for r in archive_pages(pages, str(tmp_path / "a")).collect()) == expected
    assert archive_pages(pages.limit(0), str(tmp_path / "b")).count() == 0
    lonely = archive_pages(pages, str(tmp_path / "c"), min_bytes=60_000).collect()
    assert all(r.record_type == "response" for r in lonely if r.payload_bytes < 60_000)


def test_normalised_archives_are_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "body" * (i % 3 + 1)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    written = write_pages(pages, source, roll_bytes=1500)
    index = normalise(written, source, target)
    assert written.select("archive").distinct().count() > 2 and read_archives(index, target).count() == 20
    before = {}
    for r in written.orderBy("ordinal").collect():
        before.setdefault(r.archive.removesuffix(".warc.gz"), []).append(r.page_id)
    for r in index.collect():
        whole = gzip.decompress((tmp_path / "s" / f"{r.archive.rpartition('-')[0]}.warc.gz").read_bytes())
        records = list(parse_records(iter([whole])))
        entries = list(read_sidecar(target, r.sidecar))
        data = (tmp_path / "t" / r.archive).read_bytes()
        assert [e["page_id"] for e in entries] == before[r.archive.rpartition("-")[0]] and len(entries) == r.n_records == len(records)
        assert [e["offset"] for e in entries] == [sum(x["length"] for x in entries[:i]) for i in range(len(entries))]
        assert entries[-1]["offset"] + entries[-1]["length"] == len(data)
        assert all(gzip.decompress(data[e["offset"] : e["offset"] + e["length"]]).startswith(b"WARC/1.1\r\n") for e in entries)
    with pytest.raises(ValueError, match="ends inside"):
        list(parse_records(iter([whole[:-30]])))


def test_archives_of_empty_pages_roll_too(spark, tmp_path):
    pages = spark.range(3000).selectExpr("id as page_id", "cast(null as string) as url", "cast(null as string) as html").coalesce(1)
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    index = normalise(write_pages(pages, source, roll_bytes=100_000), source, target)
    assert index.count() > 5 and index.agg({"n_records": "max"}).first()[0] < 500
    again = normalise(write_pages(pages, source, roll_bytes=100_000), source, target)  # files that are there already don't matter
    assert read_archives(again, target).count() == read_archives(index, target).count() == 3000


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("ra", "to", "vi", "wen", "zor")]

    def prose(n):
        return ". ".join(" ".join(rng.choice(vocabulary) for _ in range(9)).capitalize() for _ in range(n)) + "."

    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    base = [prose(12) for _ in range(12)]
    texts = [*base, base[0], base[1].replace(" ", "  "), "### %%% *** " * 60, "short", None, prose(12) + "\n" + passage, prose(12) + "\n" + passage, ]
    rows = [(i, t, "en", f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = durable(stage(spark, docs, str(tmp_path)), "test-stage")
        if name != "packing":
            assert out.columns == docs.columns
            seen.append({r.doc_id: r for r in out.collect()})
        docs = out
    quality, exact, near, cut = seen
    assert set(quality) == set(range(14)) | {17, 18}
    assert set(exact) == set(range(12)) - {1} | {13, 17, 18} and set(near) == set(exact)
    assert cut[17].text == texts[17] and passage not in cut[18].text and cut[18].n_chars == len(cut[18].text) < len(texts[18])
    total = {p.doc_id: p.doc_tokens for p in docs.collect()}
    assert set(total) == set(cut)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count() and len(corpus_pipeline.STAGES) == 5
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
