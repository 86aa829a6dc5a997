"""The corpus operators against brute force on small tables, with nulls, empty and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash

import __spark_entry__ as E
from rankscope.llm import bpe, nndescent, packing, quality, ring, secrets, sentences, simhash, suffixes, warc
from rankscope.llm.common import connected_components

from ..conftest import SF_SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_columns_may_be_called_like_the_operators_own(spark):
    texts = ["One two three four five. Six seven eight nine ten eleven twelve thirteen fourteen.", None, "",
             "token = abcdef123456 and more words here"]
    clash = ["_tk", "_runs", "_cut", "_id", "_key", "_text_key", "_salt", "q_key", "kept", "spans", "sd_spans", "fp",
             "component_id", "shard", "slot", "_arc", "_hash", "g", "n", "key", "id", "h", "k", "_k", "_chars", "_cuts"]
    df = docs_of(spark, texts).selectExpr("*", *[f"'{c}' as `{c}`" for c in clash])
    for out in (quality.keep_good(df), simhash.keep_one_per_component(df), secrets.mask_live(df)):
        assert out.columns == df.columns
        assert all(tuple(r)[5:] == tuple(clash) for r in out.collect())
    cut = sentences.remove_repeated_spans(df)
    assert cut.columns == [*df.columns, "sd_n_sentences", "sd_n_removed", "sd_spans"]
    assert all(tuple(r)[5:-3] == tuple(clash) for r in cut.collect())
    judged = quality.quality_verdicts(df)
    assert all(tuple(r)[4:4 + len(clash)] == tuple(clash) for r in judged.collect())
    dealt = ring.assign_shards(df, "doc_id", shards=2, epsilon=0)
    assert all(tuple(r)[5:-3] == tuple(clash) for r in dealt.collect()) and dealt.count() == 4
    whole = suffixes.remove_repeats(df)
    assert all(tuple(r)[4:4 + len(clash)] == tuple(clash) for r in whole.collect())
    assert simhash.simhash_components(df).count() == secrets.scan_secrets(df).count() == packing.pack(df).count() == 4


def test_secret_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = con.execute(E.oracle_sql()["op4_secret_ownership"]).df().sort_values("doc_id")
    got = E.queries()["op4_secret_ownership"](spark, SF_SMALL).toPandas().sort_values("doc_id")[want.columns]
    assert got.to_numpy().tolist() == want.to_numpy().tolist()


def test_catalogue_has_every_operator():
    names = E.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


# components


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    edges += [(5, 5), (None, 3), edges[0]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    lead = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(200):
        for a, b in edges:
            if a in lead and b in lead:
                lead[a] = lead[b] = min(lead[a], lead[b])
    assert got == lead
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 1 WARC


def test_warc_derivatives_round_trip(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame(
        [(1, "http://a.example/x/y", "<html><head><title>A &amp; B</title><script>no</script></head><body><p>One<br>two "
          "&eacute;</p><a href='/z'>l</a><a href=\"q?a=1&amp;b=2\">m</a><!-- hid --></body></html>"),
         (2, None, None), (3, "http://b.example/", ""), (3, "http://b.example/", "")],
        "page_id long, url string, html string")
    made = warc.build_derivatives(warc.responses(pages), "id")
    rows = made.toPandas()
    assert Counter(rows.record_type) == {"metadata": 4, "conversion": 4}
    text = rows[(rows.id == 1) & (rows.record_type == "conversion")].iloc[0]
    assert text.block == "A & B\nOne\ntwo é\nlm"
    meta = rows[(rows.id == 1) & (rows.record_type == "metadata")].iloc[0]
    assert "outlink: http://a.example/z\r\n" in meta.block
    assert "outlink: http://a.example/x/q?a=1&b=2\r\n" in meta.block
    assert f"conversion-record-id: {text.record_id}\r\n" in meta.block and meta.refers_to == text.refers_to
    assert rows[rows.id == 3].record_id.nunique() == 2 and (rows[rows.id == 2].target_uri == "").all()
    warc.write_records(made, str(tmp_path / "w"))
    records = [r for f in (tmp_path / "w").glob("*.gz") for r in warc.parse_records(gzip.open(f).read())]
    assert len(records) == 8 and all(warc.digest(b) == h["WARC-Block-Digest"] for h, b in records)
    assert {h["WARC-Refers-To"] for h, _ in records} == set(rows.refers_to)
    assert warc.build_derivatives(warc.responses(pages.limit(0)), "id").count() == 0


# 2 sentence spans


def brute_spans(rows):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        spans, found = sentences.runs(text or "")
        drop = set()
        for at, n, d in found:
            if d in seen:
                drop.update(range(at, at + n))
            seen.add(d)
        out[i] = len(drop)
    return out


def test_sentence_spans(spark, small):
    passage = "Here is one long line of words that comes back. And so does this other one, which has many words too."
    texts = [f"Alpha first one here. {passage} The end of it all.", f"Other start, quite. {passage} And then more.",
             None, "", "Short. Short. Short.", f"{passage} {passage}"]
    df = docs_of(spark, texts)
    got = sentences.remove_repeated_spans(df).toPandas().set_index("doc_id")
    assert got.text[0] == texts[0] and got.text[1] == "Other start, quite. And then more."
    assert pd.isna(got.text[2]) and got.text[3] == "" and got.text[4] == texts[4] and got.text[5].strip() == ""
    got = sentences.remove_repeated_spans(small).toPandas().set_index("doc_id")
    want = brute_spans([(r.doc_id, r.text) for r in small.collect()])
    assert got.sd_n_removed.to_dict() == want and sum(want.values()) > 0
    assert sentences.remove_repeated_spans(df.limit(0)).count() == 0


def brute_all_runs(texts):
    """Sentences removed of each text when every run of at least 2 sentences and 20 words counts."""
    seen, out = set(), []
    for text in texts:
        units = [u for u in (text[a:b].split() for a, b in sentences.pieces(text)) if u]
        drop = set()
        for a in range(len(units)):
            for b in range(a + 2, len(units) + 1):
                if sum(map(len, units[a:b])) >= 20:
                    run = tuple(map(tuple, units[a:b]))
                    if run in seen:
                        drop.update(range(a, b))
                    seen.add(run)
        out.append(len(drop))
    return out


def test_sentence_spans_cover_whole_runs(spark):
    rng = random.Random(21)

    def sentence(n):
        return " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n)) + "."

    passage = " ".join(map(sentence, (30, 30, 3, 3)))
    texts = [f"{sentence(9)} {passage} {sentence(9)}", f"{sentence(9)} {passage} {sentence(8)}", passage]
    stock = [sentence(rng.choice([1, 2, 3, 9, 12, 19, 25])) for _ in range(12)]
    for _ in range(40):
        a = rng.randrange(8)
        texts.append(" ".join([sentence(5), *stock[a:a + rng.randint(1, 6)], sentence(4), *rng.choices(stock, k=2)]))
    got = sentences.remove_repeated_spans(docs_of(spark, texts)).toPandas().set_index("doc_id").sort_index()
    assert got.sd_n_removed.tolist() == brute_all_runs(texts)
    assert got.sd_n_removed[1] == 4 and got.text[2] == ""


def test_sentence_spans_within_one_sentence(spark):
    rng = random.Random(22)

    def words(n):
        return " ".join(f"w{rng.randrange(10 ** 9)}" for _ in range(n))

    one, inner = words(60), words(50)
    texts = [one, f"{one}", f"{words(80)} {inner} {words(80)}", f"{words(30)} {inner} {words(33)}", words(384),
             f"{words(12)}. {one}. {words(9)}.", f"{words(49)}."]
    texts += [f"{texts[6]} {words(5)}."]
    got = sentences.remove_repeated_spans(docs_of(spark, texts)).toPandas().set_index("doc_id").sort_index()
    assert got.text[0] == one and got.text[1] == "" and (got.text[[2, 4, 6, 7]] == [texts[k] for k in (2, 4, 6, 7)]).all()
    assert got.sd_n_removed[3] >= 2 and 20 <= len(texts[3].split()) - len(got.text[3].split()) <= 50
    assert len(got.text[5].split()) <= 12 + 9 + 15  # the last piece ends with another word there
    for text in texts:
        units = sentences.pieces(text)
        assert "".join(text[a:b] for a, b in units) == text
        assert all(len(text[a:b].split()) <= 50 for a, b in units)


# 3 ring


def brute_ring(keys, hashes, shards, vnodes):
    points = ring.ring_points(shards, vnodes)
    arcs = defaultdict(list)
    for key, h in sorted(zip(keys, hashes), key=lambda x: (x[1], x[0])):
        arcs[sum(p < h for p, _ in points) % len(points)].append(key)
    free = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    out = {}
    for hop in range(shards):
        for arc in sorted(arcs):
            order = ring.shard_order(points, arc)
            for key in arcs[arc]:
                if key not in out and free[order[hop]]:
                    out[key] = order[hop]
                    free[order[hop]] -= 1
    return out


def test_ring_matches_key_by_key_offers(spark):
    from pyspark.sql import functions as F

    df = spark.range(1003).select(F.col("id").alias("k"))
    hashes = {r.k: r.h for r in df.select("k", F.xxhash64(F.concat(F.lit("="), F.col("k").cast("string"))).alias("h"))
              .collect()}
    got = ring.assign_shards(df, "k", shards=5, vnodes=16, epsilon=0).toPandas()
    assert dict(zip(got.k, got["shard"])) == brute_ring(list(hashes), list(hashes.values()), 5, 16)
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    more = ring.assign_shards(df, "k", shards=6, vnodes=16, epsilon=0).toPandas().set_index("k")["shard"]
    assert (more.reindex(got.k).to_numpy() != got["shard"].to_numpy()).mean() < 0.4


def test_ring_by_size_and_edges(spark):
    rng = random.Random(2)
    rows = [(k if k % 50 else None, rng.randint(1, 30)) for k in range(2000)] + [(7, 5), (7, 5)]
    got = ring.assign_shards(spark.createDataFrame(rows, "k long, size long"), "k", "size", epsilon=0.05).toPandas()
    assert len(got) == 2002
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() <= 1.05 * loads.mean() + 64 * 30
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    assert ring.assign_shards(spark.createDataFrame([], "k long, size long"), "k", "size").count() == 0


def test_ring_query_contract(spark, small):
    got = E.queries()["op3_bounded_ring"](spark, SF_SMALL).toPandas().set_index("doc_id")
    sizes = got.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == small.count()
    for r in small.collect():
        data = (r.text or "").encode()
        assert (got["size"][r.doc_id], got.text_crc32[r.doc_id]) == (len(data) + 1, zlib.crc32(data))


# 4 secrets

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.I | re.A)
ORDER = ["assign", "access", "hex", "owned"]


def brute_secrets(rows):
    found, owners = {}, defaultdict(set)
    for i, text, owner in rows:
        t = text or ""
        base = [("assign", m.start(), m.end(), m[1]) for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
        base += [("access", m.start(), m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        more = [("owned", m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]+", t) if len(m[0]) >= 24
                and all(re.search(c, m[0]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
        for s in base + more:
            owners[s[3]].add(owner)
        found[i] = base, more
    out = {}
    for i, (base, more) in found.items():
        kept = [s for s in more if len(owners[s[3]]) == 1 and not any(b[1] < s[2] and s[1] < b[2] for b in base)]

        def text(spans):
            return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in sorted(spans, key=lambda s: (s[1], ORDER.index(s[0]))))
        out[i] = hashlib.sha256(text(base).encode()).hexdigest(), text(base + kept)
    return out


def secret_texts():
    long = "Zq8" + "aB3" * 9
    return ["é pass Password = hunter22 and token:'abc' x", "AKIA" + "Q7" * 9 + " api_key=" + "0f" * 14, "0af3" * 7,
            None, "", f"key {long} here", f"secret: {long}x", "tokEN=" + "x" * 6 + " API-KEY=nope apikey\"= 'longer.one'",
            "0af3" * 7 + " again", "0af3" * 7, "0af3" * 7, "password=short token=ok1234 " * 3]


def test_secret_spans(spark, tmp_path):
    df = docs_of(spark, secret_texts())
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = E.queries()["op4_secret_ownership"](spark, str(tmp_path)).toPandas().set_index("doc_id")
    want = brute_secrets([(r.doc_id, r.text, r.source) for r in df.collect()])
    assert {i: (r.base_sha256, r.spans) for i, r in got.iterrows()} == want
    assert got.spans.str.contains("owned").sum() == 1


def test_secret_masks(spark):
    df = docs_of(spark, secret_texts())
    got = secrets.mask_live(df).toPandas().set_index("doc_id")
    assert got.text[0] == "é pass Password = [SECRET] and token:'abc' x"
    assert got.text[2] == "0af3" * 7 and got.text[9] == "0af3" * 7  # three owners have it: an example
    assert pd.isna(got.text[3]) and got.text[4] == "" and got.text[5] == "key [SECRET] here"
    twice = df.union(df)
    assert secrets.scan_secrets(twice).count() == 2 * df.count() == secrets.mask_live(twice).count()
    assert secrets.scan_secrets(df.limit(0)).count() == 0 and secrets.mask_live(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op4_secret_ownership", "op8_robust_outliers"])
def test_native_plans_run_no_python(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 5 embeddings


def test_nn_descent_links(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 16))
    dense = rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.15
    pairs = base[:60] + rng.normal(size=(60, 16)) * 0.05
    x = np.vstack([base, dense, pairs, base[:3]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16]
    rows += [(n + k, v) for k, v in enumerate(odd)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    got = got.set_index("id").sort_index()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.minimum(got.n_links.to_numpy()[:n], near.sum(1)).sum()
    assert (got.n_links.to_numpy()[:n] <= near.sum(1)).all() and found >= 0.97 * near.sum()
    assert (got.n_links[n:] == 0).all() and (got.component_id[n:] == got.index[n:]).all() and got.kept[n:].all()
    assert (got.kept == (got.index == got.component_id)).all()
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert nndescent.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("stall", [3, 0])
def test_nn_descent_reaches_its_recall_from_a_poor_start(spark, monkeypatch, stall):
    """Runs of 2 rows in one order meet few pairs."""
    monkeypatch.setattr(nndescent, "ORDERS", 1)
    monkeypatch.setattr(nndescent, "RUN", 2)
    monkeypatch.setattr(nndescent, "STALL_ROUNDS", stall, raising=False)  # 0: all pairs after the first round
    monkeypatch.setattr(nndescent, "WHOLE_BLOCK", 300, raising=False)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(700, 64))
    hub = rng.normal(size=64) + rng.normal(size=(30, 64)) * 0.1
    x = np.vstack([base, base + rng.normal(size=(700, 64)) * 0.4, hub, hub[:2]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    got = got.set_index("id").sort_index()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() > 1400 and (got.n_links <= near.sum(1)).all()
    assert got.n_links.sum() >= 0.97 * near.sum()
    if not stall:
        assert (got.n_links == near.sum(1)).all()
        want = connected_components(spark.createDataFrame(np.argwhere(near).tolist(), "u long, v long")).toPandas()
        assert (got.component_id[want.node] == want.component.to_numpy()).all()


def test_nn_descent_audits_enough_linked_vectors(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "AUDIT_ROWS", 8)
    x = np.random.default_rng(6).normal(size=(3000, 32))
    x[-300:] = x[:300] * 2 + 0.001
    rows = [(i, v.tobytes()) for i, v in enumerate(x)]
    nodes = spark.createDataFrame(rows, "node long, vec binary")
    true = nndescent.linked_sample(nodes, 32, 0.9, len(rows)).toPandas()
    assert len(true) >= nndescent.AUDIT_LINKED and (true.n == 1).all()


# 6 BPE


@pytest.fixture(scope="module")
def codecs():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(codecs):
    own, other = codecs
    rng = random.Random(4)
    parts = ["a", "b", "the", "ing", " ", "é", "ß", "日本", "\n", "  ", "22", "AAAA", "!", "'s", "\U0001f600", "\t", "xyz"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 80))) for _ in range(400)]
    texts += ["a" * 4000, "ab" * 2000, " " * 1000, "é" * 1500, "", "".join(rng.choices("abcdef", k=5000))]
    for text in texts:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == other.encode_ordinary(text)
        assert own.decode(packed) == text.encode()


def test_bpe_documents(spark, small, codecs):
    got = E.queries()["op6_byte_bpe"](spark, SF_SMALL).toPandas().set_index("doc_id")
    for r in small.collect():
        ids = np.array(codecs[1].encode_ordinary(r.text or ""), dtype="<u4").tobytes()
        assert tuple(got.loc[r.doc_id]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                            hashlib.sha256((r.text or "").encode()).hexdigest())
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = docs_of(spark, [None, "", "two words", "two words"])
    both = bpe.decode_documents(bpe.encode_documents(df, path, public_tokenizers.PATTERN), path,
                                public_tokenizers.PATTERN).collect()
    assert [bytes(r.decoded).decode() for r in both] == ["", "", "two words", "two words"]


# 7 SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items, near):
    lead = list(range(len(items)))

    def find(a):
        while lead[a] != a:
            a = lead[a]
        return a
    for a in range(len(items)):
        for b in range(a):
            if near(items[a], items[b]):
                x, y = sorted((find(a), find(b)))
                lead[y] = x
    return [find(a) for a in range(len(items))]


def test_simhash_fingerprints_and_components(spark, small):
    rows = small.collect()
    got = E.queries()["op7_simhash_bktree"](spark, SF_SMALL).toPandas().set_index("doc_id")
    prints = [brute_fingerprint(r.text) for r in rows]
    assert [int(got.fingerprint[r.doc_id], 16) for r in rows] == prints
    lead = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    group = defaultdict(list)
    for r, k in zip(rows, lead):
        group[k].append(r.doc_id)
    assert all(got.component_id[i] == min(ids) for ids in group.values() for i in ids)


@pytest.mark.parametrize("shard_rows", [4096, 3])
def test_bk_tree_links_lose_no_pair(spark, shard_rows):
    rng = random.Random(5)
    prints = {0, 1 << 63}
    for _ in range(40):
        f = rng.getrandbits(64)
        prints.add(f)
        for _ in range(rng.randint(0, 8)):
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.near_links(df, 3, shard_rows).collect()]
    at = {p: k for k, p in enumerate(prints)}
    joined = {frozenset((at[a], at[b])) for a, b in links}
    own = brute_components(list(range(len(prints))), lambda a, b: frozenset((a, b)) in joined)
    assert own == brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 3)


def test_simhash_keeps_one_document(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, text), (1, text.upper()), (None, text), (2, "other words entirely here now"), (4, None), (5, ""),
            (6, "  "), (2, "other words entirely here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    kept = simhash.keep_one_per_component(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert simhash.keep_one_per_component(df.limit(0)).count() == 0
    comp = simhash.simhash_components(df).collect()
    assert len(comp) == 8 and {r.component_id for r in comp if r.id in (1, 3, None)} == {1}


# 8 quality


def brute_counts(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = list(zip(words, words[1:], words[2:]))
    count = Counter(grams)
    hit = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)]


def test_quality_counts(spark, small):
    odd = docs_of(spark, [None, "", "a b", "a b c a b c", "x y   z", "l\nl\n \nl", "a " * 500, "é#*$%&|<> \x0b\x0c\r"])
    for df in (small, odd):
        got = quality.text_statistics(df).toPandas().set_index("doc_id")
        for r in df.collect():
            assert got.loc[r.doc_id, ["q_words", "q_word_chars", "q_symbols", "q_dup_lines", "q_repeat_words"]].tolist() \
                == brute_counts(r.text)


def test_mcd_against_numpy(spark):
    rng = np.random.default_rng(6)
    mix = np.array([[1, 0, 0, 0], [0.6, 1, 0, 0], [0, 0.3, 1, 0], [0, 0, 0, 0.5]])
    clean, bad = rng.normal(size=(900, 4)) @ mix.T, rng.normal(size=(100, 4)) * 0.3 + 9
    x = np.vstack([clean, bad])
    names, floors = list("abcd"), [0.1] * 4
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, a double, b double, c double, d double")
    est = quality.mcd_estimates(df, names, floors).first()

    mid = np.sort(x, axis=0)[(len(x) + 1) // 2 - 1]
    spread = np.sort(np.abs(x - mid), axis=0)[(len(x) + 1) // 2 - 1]
    cov = np.diag((spread * 1.4826) ** 2 + 0.01)
    for _ in range(30):
        d2 = np.einsum("ij,jk,ik->i", x - mid, np.linalg.inv(cov), x - mid)
        near = x[d2 <= np.sort(d2)[int(np.ceil(0.75 * len(x))) - 1]]
        mid, cov = near.mean(0), np.cov(near.T, bias=True) / quality.SUBSET_SCATTER + 0.01 * np.eye(4)
    factor = np.linalg.cholesky(cov)
    assert np.allclose([est[f"m_{i}"] for i in range(4)], mid, atol=0.02)
    assert np.allclose([[est[f"l_{i}_{j}"] if j <= i else 0 for j in range(4)] for i in range(4)], factor, atol=0.03)
    judged = quality._with_distance(df.join(quality.mcd_estimates(df, names, floors), "g"), names, "d2").toPandas().d2
    assert (judged > quality.CHI_CUT).sum() >= 100 and (np.sort(judged)[:900] < quality.CHI_CUT).mean() > 0.99


def test_quality_verdicts(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]

    def prose(n):
        return "\n".join(" ".join(rng.choices(vocabulary, k=12)) + "." for _ in range(n // 12))
    texts = [prose(rng.randint(80, 400)) for _ in range(150)]
    junk = [" ".join(w + rng.choice(["%%%", "$$$"]) for w in prose(200).split()) for _ in range(8)]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts + junk + [None, "", "few words", "a b c " * 100])]
    df = spark.createDataFrame([*rows, rows[0], (None, texts[1], None, None, None)], DOCS)
    got = quality.quality_verdicts(df).toPandas()
    n = len(texts)
    one = got.dropna(subset="doc_id").drop_duplicates("doc_id").set_index("doc_id").sort_index()
    one.index = one.index.astype(int)
    assert one.kept[:n].all() and not one.kept[n:].any()
    assert one.base_failed.tolist() == [False] * (n + 8) + [True] * 4
    assert len(got) == len(rows) + 2 and got[got.doc_id == 0].kept.all() and got[got.doc_id.isna()].kept.all()
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == n + 2
    assert quality.quality_verdicts(df.limit(0)).count() == 0


# 9 suffixes


def brute_repeats(texts, length):
    count = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t) + 1, dtype=int)
        for k in range(len(t) - length + 1):
            if count[t[k:k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        starts = gone & ~np.r_[False, gone[:-1]] if len(t) else gone
        out.append((len(t), int(gone.sum()), int(starts.sum()), bytes(np.frombuffer(t, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("hot", [suffixes._HOT_ROWS, 1])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "_HOT_ROWS", hot)
    rng = random.Random(8)
    base = ["".join(rng.choices("abé \n", k=700)) for _ in range(4)]
    texts = []
    for _ in range(60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 500)
            t += rng.choice(base)[a:a + rng.randint(50, 400)] + "".join(rng.choices("xyz", k=rng.randint(0, 3)))
        texts.append(t)
    texts += ["a" * 1000, "a" * 300, "ab" * 400, None, "", texts[3], texts[3], "q" * 199, "q" * 200, "é" * 150]
    got = suffixes.remove_repeats(docs_of(spark, texts)).toPandas().sort_values("doc_id")
    found = [(r.sa_n_bytes, r.sa_n_removed, r.sa_n_spans, bytes(r.sa_kept)) for r in got.itertuples()]
    assert found == brute_repeats([(t or "").encode() for t in texts], 200)
    assert suffixes.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def test_suffix_query(spark, small):
    rows = sorted(small.collect(), key=lambda r: r.doc_id)
    got = E.queries()["op9_difference_cover"](spark, SF_SMALL).toPandas().sort_values("doc_id")
    want = [(*w[:3], hashlib.sha256(w[3]).hexdigest()) for w in brute_repeats([(r.text or "").encode() for r in rows], 200)]
    assert list(got[["n_bytes", "n_removed", "n_spans", "kept_sha256"]].itertuples(index=False, name=None)) == want


def test_samples_in_chunks(monkeypatch):
    data = bytes(random.Random(9).choices(b"abcd", k=5000))
    whole = suffixes.samples(data)
    monkeypatch.setattr(suffixes, "_CHUNK", 700)
    assert all((a == b).all() for a, b in zip(whole, suffixes.samples(data)))


# 10 packing


def brute_pack(lengths, sources, clusters, capacity):
    bins, residuals = [], []
    for n, s, c in zip(lengths, sources, clusters):
        fit = [b for b in bins if b[0] >= n and s not in b[1] and c not in b[2]]
        best = min(fit, key=lambda b: b[0]) if fit else None
        if best is None:
            best = [capacity, set(), set()]
            bins.append(best)
        residuals.append(best[0])
        best[0] -= n
        best[1].add(s)
        best[2].add(c)
    return residuals


def test_best_fit_takes_the_tightest_bin():
    rng = random.Random(10)
    for _ in range(150):
        n, capacity = rng.randint(0, 60), rng.choice([1, 9, 50])
        lengths = sorted((rng.randint(0, capacity) for _ in range(n)), reverse=True)
        clusters = [rng.randint(0, 30) for _ in range(n)]
        sources = list(range(n))  # without ties in conflicts the choice is the same up to equal residuals
        places = packing.best_fit(lengths, sources, list(range(n)), capacity)
        assert [capacity - o for _, o in places] == brute_pack(lengths, sources, list(range(n)), capacity)
        sources = [rng.choice([None, "a", "b", "c"]) for _ in range(n)]
        state = {}
        for (b, o), size, s, c in zip(packing.best_fit(lengths, sources, clusters, capacity), lengths, sources, clusters):
            tight = [u for u in state.values() if u[0] >= size and s not in u[1] and c not in u[2]]
            own = state.setdefault(b, [capacity, set(), set()])
            assert own[0] == capacity - o and s not in own[1] and c not in own[2]
            assert own[0] == (min(u[0] for u in tight) if tight else capacity)
            own[0] -= size
            own[1].add(s)
            own[2].add(c)


def test_packing(spark, small):
    got = packing.pack(small, capacity=300, group_rows=64).toPandas()
    words = {r.doc_id: len((r.text or "").split()) for r in small.select("doc_id", F_text()).collect()}
    assert got.groupby("id").n_words.sum().to_dict() == words
    assert (got.groupby("bin_id").n_words.sum() <= 300).all()
    source = {r.doc_id: (r.source, r.text) for r in small.collect()}
    got["source"], got["text"] = [source[i][0] for i in got.id], [source[i][1] for i in got.id]
    assert not got.duplicated(["bin_id", "source"]).any() and not got.duplicated(["bin_id", "text"]).any()
    odd = docs_of(spark, [None, "", "one two", "one two"])
    odd = odd.union(odd.selectExpr("null", "text", "null", "null", "null"))
    assert packing.pack(odd).toPandas().groupby("bin_id").n_words.sum().max() <= packing.CAPACITY
    assert packing.pack(odd).count() == 8 and packing.pack(odd.limit(0)).count() == 0


def F_text():
    from pyspark.sql import functions as F

    return F.translate("text", "\x0b\x0c  ", "  xx").alias("text")
