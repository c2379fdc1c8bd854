"""The operators against plain Python, on whole small tables and on odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobvigil.llm import chat, fingerprints, language, mixing, neighbours, ngram_join, packing, pii, queries, token_files, url_filters
from jobvigil.llm.tokens import encoder
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rest int, spans string, fingerprint string, drawn int, host string"
#: Null, empty and long texts, repeated rows, a null key, characters beyond the basic plane, columns with the names the operators use.
LONG = "word " * 30_000 + "a@b.cc"
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "Hi. 😀 x@y.zz +1 (234) 555-6789\n", "en", None, 3), (3, "Hi. 😀 x@y.zz +1 (234) 555-6789\n", "en", None, 3),
    (4, LONG, "en", "s", 4), (5, LONG, "en", "s", 4), (None, "no key here at all", "de", "t", 1), (6, " \n\t ", "de", "t", 1), (7, "İ'S it’s ½ 日本 1.2.3.4 5.6.7.8.9", None, "t", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", "y", 2, "z") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def both(frame, run):
    """The operator on the frame, and on an empty one."""
    assert run(frame.limit(0)).count() == 0
    return run(frame).collect()


def library(name, text):
    tokenizer = Tokenizer.from_file(queries.vocabulary_file(name))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [queries.WORD_VOCABULARY, queries.BYTE_VOCABULARY])
def test_encoder_gives_the_ids_of_the_library(name, documents):
    rng = np.random.default_rng(3)
    letters = list("aAbZ09 \n\t'sSdDrReElLtT.,!?@+-_<|>é½²İſǅ") + [chr(c) for c in (0x301, 0x2009, 0x3000, 0xA0, 0x85, 0x1C, 0x2028, 0xAD, 0x1F600)]
    texts = ["".join(rng.choice(letters, rng.integers(1, 40))) for _ in range(800)] + [t or "" for _, t, *_ in ODD] + [t for _, t in documents[:60]] + ["a<|endoftext|>b"]
    found = encoder(queries.vocabulary_file(name))(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library(name, t) for t in texts]


# URL filters


def plain_verdict(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host, path = rest, ""
    for i, c in enumerate(rest):
        if c in "/?#":
            host, path = rest[:i], rest[i:].split("?")[0].split("#")[0]
            break
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def test_urls(spark):
    urls = [
        None, "", "no scheme.org/", "http://", "http://ORG/", "http://a.org", "http://a.org/x", "http://xexample.org/es/1", "http://Example.ORG/es/", "https://m.example.org/en/12?q=/es/",
        "x://b.example.org/en/2#/en/1", "http://com/fr/", "http://a.com/de/1", "http://a.com/DE/1", "http://u@b.com:80/de/", "http://É.org//", "http://a.org/" + "x/" * 5000, "a://b://c.org/x", "http://a.net\n.org/x",
    ]
    pages = spark.createDataFrame([(i, u, "h", "p", 1) for i, u in enumerate(urls + urls[5:8])], "page_id long, url string, host string, Path string, number int")
    rows = {r["page_id"]: r for r in both(pages, lambda p: url_filters.judge_urls(p, queries.URL_RULES))}
    for i, url in enumerate(urls + urls[5:8]):
        host, path, rule, verdict = plain_verdict(url)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule), url
        assert rows[i]["verdict"] == (verdict or "allow") and rows[i]["number"] == 1


def test_rules_without_a_whole_token_are_tried_on_every_url(spark):
    pages = spark.createDataFrame([(1, "http://a.net/b77"), (2, "http://a.net/c"), (3, "http://login.net/login")], "page_id long, url string")
    judged = url_filters.judge_urls(pages, [url_filters.Rule("block", pattern="b7+")])
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in judged.collect()} == {1: ("/b7+/", "block"), 2: (None, "allow"), 3: (None, "block")}


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("a.example.org", "/en/1"), ("b.example.org", "/fr/1"), ("org", "/en/")], "host string, path string")
    filed = url_filters.file_rules(urls, url_filters.rule_table(spark, queries.URL_RULES, ()))
    # org is in three, example in two, en in two, es in none
    assert {r["name"]: r["token"] for r in filed.collect()} == {"org/": "org", "example.org/es/": "es", "example.org/en/1": "en", "com/fr/": "com", "com/de/": "com"}


# packing and token files


def test_packing(odd):
    rows = both(odd, lambda d: packing.pack(d, queries.vocabulary_file(queries.WORD_VOCABULARY), longest=64))
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and len(r["ids"]) == 4 * r["length"] for r in rows)
    for doc, text in {(r[0], r[1]) for r in ODD}:
        want = [*library(queries.WORD_VOCABULARY, text or ""), 2]
        pieces = sorted((r["start"], bytes(r["ids"])) for r in rows if r["doc_id"] == doc)
        copies = sum(r[0] == doc for r in ODD)
        assert len(pieces) == copies * len(packing.piece_lengths(len(want), 64))
        assert np.frombuffer(b"".join(p for _, p in sorted(set(pieces))), "<u4").tolist() == want


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 200])
def test_piece_lengths(n):
    assert sum(packing.piece_lengths(n, 64)) == n and len(packing.piece_lengths(n, 64)) <= n // 64 + 6


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 25, 32])
def test_bits(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 70_001)
    payload = token_files.pack_bits(ids, bits)
    assert len(payload) == -(-len(ids) * bits // 8)
    assert np.array_equal(token_files.unpack_bits(payload, bits, 65_530, 4_000), ids[65_530:69_530])
    with pytest.raises(ValueError):
        token_files.pack_bits([1 << bits], bits) if bits < 32 else token_files.pack_bits([2], 1)


def test_token_files(spark, odd, tmp_path):
    for name, frame, want in (("none", odd.limit(0), []), ("all", odd, sorted(((r[0], r[1] or "") for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0)))):
        path = f"file://{tmp_path}/{name}"
        token_files.write_token_files(frame, path, queries.vocabulary_file(queries.BYTE_VOCABULARY), 50_257)
        rows = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["start"])
        assert [r["key"] for r in rows] == [k for k, _ in want]
        ids, at = [], 0
        for r, (_, text) in zip(rows, want, strict=True):
            own = [*library(queries.BYTE_VOCABULARY, text), 2]
            assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (at, len(own), own)
            ids, at = ids + own, at + len(own)
        assert token_files.read_range(spark, path, 5, 100) == ids[5:105]
        for first, n in ((0, 1), (len(ids) - 1, 1), (len(ids) - 1, 50), (len(ids), 5), (3, 0), (0, len(ids))):
            assert token_files.read_range(spark, path, first, n) == ids[first : first + n]


def test_a_range_of_ids_is_read_from_its_files(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"text of document {i} " * 40) for i in range(400)], "doc_id long, text string")
    token_files.write_token_files(rows, path, queries.vocabulary_file(queries.BYTE_VOCABULARY), 50257)
    files = spark.read.parquet(f"{path}/index").orderBy("part").collect()
    assert len(files) > 3
    first = sum(f["n_ids"] for f in files[:2])
    ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in token_files.read_documents(spark, path).orderBy("start").collect()), "<u4").tolist()
    for start, n, parts in ((first, 10, files[2:3]), (first - 1, 2, files[1:3]), (0, 1, files[:1])):
        found = token_files.blocks_of_range(spark, path, start, n)
        low, high = parts[0]["part"], parts[-1]["part"]
        assert {r["part"] for r in found.select("part").collect()} == set(range(low, high + 1))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual(part,{low})" in plan and f"LessThanOrEqual(part,{high})" in plan
        assert token_files.read_range(spark, path, start, n) == ids[start : start + n]
    assert token_files.read_range(spark, path, len(ids), 5) == []


# chat


def test_chat(spark):
    said = [
        (1, 2, "user", "b"), (1, 1, "user", "a<|next|>\\<|"), (1, 3, "assistant", None), (1, 4, "assistant", "<\\|done|>\\"), (1, 4, "assistant", "<\\|done|>\\"), (1, None, None, "first"),
        (None, 1, "assistant", "x" * 50_000), (2, 1, "us<|er", ""), (2, 1, "assistant", "<"), (2, 2, "assistant", "|from|>"),
    ]
    rows = spark.createDataFrame([(*s, 1, "f") for s in said], "conv_id long, turn int, role string, text string, turns int, formatted string")
    made = both(rows, lambda r: chat.format_conversations(r).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))))
    by = {r["conv_id"]: r for r in made}
    for conv in (1, 2, None):
        turns = sorted((s for s in said if s[0] == conv), key=lambda s: (s[1] is not None, s[1] or 0, s[2] or "", s[3] or ""))
        assert [(t["role"], t["text"]) for t in by[conv]["back"]] == [(t[2] or "", t[3] or "") for t in turns]
        assert by[conv]["loss"] == "".join(t[3] or "" for t in turns if t[2] == "assistant")
        assert "".join(s["text"] for s in by[conv]["segments"]) == by[conv]["formatted"]
    assert by[1]["formatted"].count(chat.FROM) == 3 and by[1]["formatted"].startswith("<|from|><|says|>first<|done|><|from|>user<|says|>a<\\|next|>")


# personal data


def spans(row):
    return [(pii.KINDS[s["kind"]].name, s["start"], s["end"]) for s in row["spans"]]


TRICKY = [
    "a@b.c-d_e@f.g", "a@b.c." + "c." * 3000 + "d", "x" * 50_000, "9" * 50_000 + ".1.2.3", "1.2.3.4.5.6.7.8.9", "256.1.1.1 0255.001.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "4111  1111",
    "0" * 40_000, "1 " * 20_000, "+1 (234) 555-6789. +12 3", "++1 23 45 67 89--0+", "😀 a@b.c 😀 1.2.3.4", "a@b a@b.c@d.e", "+" + " 1" * 9, "", "x@y." * 500,
]


def test_base_spans(spark, documents):
    texts = TRICKY + [t or "" for _, t, *_ in ODD] + [t for _, t in documents]
    rng = np.random.default_rng(5)
    texts += ["".join(rng.choice(list("a1.@+ -()4_"), rng.integers(1, 60))) for _ in range(500)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    for row in pii.find_pii(frame).collect():
        base = [s for s in spans(row) if s[0] in pii.BASE_KINDS]
        assert base == brute.base_spans(texts[row["doc_id"]]), texts[row["doc_id"]][:80]


def test_other_kinds_and_context(spark):
    texts = [
        "Konto GB82 WEST 1234 5698 7654 32 here", "GB82 WEST 1234 5698 7654 33", "my SSN is 123-45-6789", "part 123-45-6789", "call (234) 555-6789", "size 234-555-6789", "mail me: a@b.cc",
    ]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_pii(frame).collect()}
    assert [[k for k, _, _ in spans(found[i])] for i in range(7)] == [["iban"], [], ["ssn"], [], ["local_phone"], [], ["email"]]
    assert found[6]["spans"][0]["score"] == 1.0


def test_redaction(odd, spark):
    rows = both(odd, pii.redact_pii)
    assert all(r["spans"] == "x" for r in rows) and len(rows) == len(ODD)
    by = {r["doc_id"]: r["text"] for r in rows}
    assert by[3] == "Hi. 😀 [EMAIL] [PHONE]\n" and by[1] is None and by[2] == "" and by[4] == LONG.replace("a@b.cc", "[EMAIL]")
    # the phone number lies within the card's digits and goes with it
    one = pii.redact_pii(spark.createDataFrame([(1, "x +4111 1111 1111 1111 y 1.2.3.4")], "doc_id long, text string")).first()["text"]
    assert one == "x [PHONE] y [IP]" or one == "x +[CARD] y [IP]"


# fingerprints


def test_fingerprints(spark, odd):
    rows = both(odd, fingerprints.fingerprint)
    assert [r["fingerprint"] for r in rows if r["doc_id"] == 1] == [r["fingerprint"] for r in rows if r["doc_id"] == 2]
    frame = spark.createDataFrame([("A b. C d.\nE", "E", "C d.\nA b. E", "A b. C d.\nE")], "whole string, last string, turned string, other string")
    lanes = {c: fingerprints.lanes_of(F.col(c)) for c in frame.columns}
    same = lambda a, b: fingerprints.to_text(a) == fingerprints.to_text(b)
    without = fingerprints.combine(lanes["whole"], lanes["last"], -1)
    row = frame.select(
        same(lanes["whole"], lanes["turned"]).alias("order"), same(fingerprints.combine(without, lanes["last"]), lanes["whole"]).alias("back"),
        same(without, lanes["whole"]).alias("gone"), same(without, fingerprints.lanes_of(F.lit("A b. C d.\n"))).alias("left"),
        fingerprints.likeness(fingerprints.to_text(lanes["whole"]), fingerprints.to_text(lanes["other"])).alias("one"),
    ).first()
    assert tuple(row) == (True, True, False, True, 1.0)


def test_likeness_of_long_texts(spark):
    text = lambda first, n: "".join(f"{i}\n" for i in range(first, first + n))
    frame = spark.createDataFrame([(text(0, n), text(n - same, n), same / (2 * n - same)) for n, same in ((60_000, 0), (60_000, 30_000), (200_000, 0))], "a string, b string, want double")
    prints = frame.select("want", *(fingerprints.to_text(fingerprints.lanes_of(F.col(c))).alias(c) for c in "ab"))
    for r in prints.select("want", fingerprints.likeness(F.col("a"), F.col("b")).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 0.2


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_next_rows(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(i), f"t{i % 7}") for i in rng.integers(-50, 50, 40)] + [(10**15, "far"), (None, "none"), (7, "a"), (7, "a"), (7, "b")]
    got = fingerprints.beside_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"], parts).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = [(order[i], order[(i + 1) % len(order)]) for i in range(len(order))]
    assert sorted(map(repr, want)) == sorted(repr(((r["doc_id"], r["text"]), (r["next_doc_id"], r["next_text"]))) for r in got)


def test_fingerprint_query(spark, sf_dir, documents):
    want = brute.edited(documents)
    errors = []
    for r in queries.op5_fingerprints(spark, sf_dir).collect():
        text, edited, following = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"] == 1.0) == (text == edited)
        errors += [abs(r["near_edited"] - brute.likeness(text, edited)), abs(r["near_next"] - brute.likeness(text, following))]
    assert np.mean(errors) < 0.08


# mixing


def test_mixing(spark, odd):
    rows = both(odd, mixing.mix_sources)
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD} and set(rows[0].asDict()["drawn"].asDict()) == {"epoch", "block", "block_rank", "slot"}
    docs = [(i, "w " * (1 + i % 50), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for mix in (mixing.Mix(0.999, 3.0, 500), mixing.Mix(0.5, 2.0, 500), mixing.Mix(1.0, 100.0, 10**6)):
        narrow, sources, _ = mixing.plan_mix(frame, mix, "doc_id", "text", "source")
        drawn = mixing.mix_sources(frame, mix).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("words")).collect()
        plan = {r["s"]: r for r in sources.collect()}
        p = np.array([r["source_words"] for r in plan.values()], float)
        w = np.array([r["source_words"] * r["passes"] for r in plan.values()])
        w /= w.sum()
        entropy, most = -(w * np.log(w)).sum() / np.log(len(w)), max(r["passes"] for r in plan.values())
        assert most <= mix.repeats + 1e-4
        assert entropy >= mix.entropy - 1e-4 or most >= mix.repeats - 1e-3 or np.allclose(w, p / p.sum())
        for r in drawn:  # a budget is met to less than a document
            assert plan[r["source"]]["budget"] - 50 <= r["words"] <= plan[r["source"]]["budget"]
        assert min(r["passes"] for r in plan.values()) == 1.0


# neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(600)] + [(600 + i, [1.0] * 8) for i in range(300)]
    bad = [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [float("nan")] + [1.0] * 7), (1400, [1.0] * 7 + [None]), (1500, [float("inf")] * 8), (1600, [1.0] * 9), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, leaf int, id string")
    asked = F.col("vec_id") % 100 == 0
    for search in (neighbours.Search(sample=300, per_leaf=16, block=64), neighbours.Search()):
        got = both(frame, lambda f: neighbours.nearest_neighbours(f, asked, search=search))  # noqa: B023
        ids, v = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
        hits = 0
        for q in range(0, 900, 100):
            far = np.sqrt(((v - v[ids == q][0]) ** 2).sum(axis=1))
            true = [int(i) for i in ids[np.lexsort((ids, far))] if i != q][:10]
            own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
            assert [r["rank"] for r in own] == list(range(1, 11))
            assert [(r["score"], r["vec_id"]) for r in own] == sorted((float(far[ids == r["vec_id"]][0]), r["vec_id"]) for r in own)
            hits += len(set(true) & {r["vec_id"] for r in own})
        assert {r["query_id"] for r in got} == set(range(0, 900, 100)) and hits >= 0.9 * 90
    few = frame.where("vec_id in (0, 1, 2)")
    assert [(r["vec_id"], r["rank"]) for r in neighbours.nearest_neighbours(few, asked).orderBy("rank").collect()] and neighbours.nearest_neighbours(few, asked).count() == 2


def test_queries_apart_from_tight_groups_get_all_neighbours(spark):
    rng = np.random.default_rng(3)
    groups = rng.normal(size=(30, 8)) * 10
    rows = [(i, groups[i % 30].tolist(), i < 90) for i in range(900)] + [(1000 + i, (500.0 + 9 * rng.normal(size=8)).tolist(), i == 0) for i in range(4)]
    rows += [(2000, [-700.0] * 8, i == 0) for i in range(25)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ask boolean")
    got = neighbours.nearest_neighbours(frame, F.col("ask"), search=neighbours.Search(per_leaf=4)).collect()
    ranks = {}
    for r in got:
        assert r["vec_id"] != r["query_id"]
        ranks.setdefault(r["query_id"], []).append(r["rank"])
    assert set(ranks) == {*range(90), 1000, 2000} and all(sorted(r) == list(range(1, 11)) for r in ranks.values())
    assert {1001, 1002, 1003} <= {r["vec_id"] for r in got if r["query_id"] == 1000}


# n-gram join


def plain_groups(rows, like):
    def shingles(text):
        said = (text or "").encode().lower().split()
        return {tuple(said[i : i + like.words]) for i in range(len(said) - like.words + 1)} or ({tuple(said)} if said else set())

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if (both and like.of * both >= like.least * (len(a) + len(sets[j]) - both)) or rows[i][0] == rows[j][0]:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    group = {}
    for i, (key, _) in enumerate(rows):
        group.setdefault(find(i), []).append(key)
    return sorted((key, len(sets[i]), min(group[find(i)])) for i, (key, _) in enumerate(rows))


def near_copies(seed, sizes):
    rng = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        base = [f"w{i}" for i in rng.integers(0, 10**6, size)]
        for _ in range(6):
            words = list(base)
            for _ in range(rng.integers(0, max(2, size // 40))):
                at, kind = rng.integers(0, max(1, len(words))), rng.integers(3)
                words[at : at + (kind != 0)] = [] if kind == 2 else [f"x{rng.integers(0, 10**6)}"]
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return [(int(i), t) for i, t in rows]


@pytest.mark.parametrize("like", [ngram_join.Likeness(3, 90, 100), ngram_join.Likeness(), ngram_join.Likeness(2, 50, 100)])
def test_ngram_join(spark, like, monkeypatch):
    rows = near_copies(2, [*range(1, 60), 100, 200, 400, 900]) + [(9_000, None), (9_001, ""), (9_002, "a b"), (9_003, "A\nb"), (9_004, "a"), (9_005, "a b c d"), (9_005, "x y z q")]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, id int, one int, n int")
    got = both(frame, lambda f: ngram_join.similar_groups(f, like))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_groups(rows, like)


def test_ngram_join_of_a_large_cluster_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rng, like = np.random.default_rng(4), ngram_join.Likeness(3, 90, 100)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(0, 7)):
            words[at] = f"y{rng.integers(0, 40)}"
        rows.append((i, " ".join(words[: 150 - int(rng.integers(0, 14))])))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()
    assert sorted(tuple(r) for r in got) == plain_groups(rows, like)


def test_candidates_are_broadcast_without_the_blocks_they_meet(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    broadcast, kept = F.broadcast, []
    monkeypatch.setattr(F, "broadcast", lambda frame: kept.append(frame) or broadcast(frame))
    rng, like = np.random.default_rng(5), ngram_join.Likeness(3, 90, 100)
    rows = []
    for i in range(120):
        words = [f"w{j}" for j in range(150)]
        for at in rng.integers(0, 150, rng.integers(0, 7)):
            words[at] = f"y{rng.integers(0, 40)}"
        rows.append((i, " ".join(words[: 150 - int(rng.integers(0, 14))])))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()
    assert sorted(tuple(r) for r in got) == plain_groups(rows, like)
    names = [{c.lower() for c in frame.columns} for frame in kept]
    assert any({"id", "one", "two", "cluster"} <= n for n in names)
    assert all(t in ("bigint", "int", "boolean") for frame in kept for _, t in frame.dtypes)


def test_two_texts_under_one_id_each_link_it_in_any_order_of_rows(spark):
    rng, like = np.random.default_rng(9), ngram_join.Likeness(3, 90, 100)
    base = [f"w{i}" for i in range(150)]

    def changed(*places):
        return " ".join(f"z{i}" if i in places else w for i, w in enumerate(base))

    one, other = changed(3, 70), changed(40, 41, 42, 110, 111, 112)
    rows = [(5, one), (5, other), (9, changed(3, 70, 10)), (8, changed(40, 41, 42, 110, 111, 112, 140)), (7, "nothing like it at all"), (7, None), (4, "nothing like it at all")]
    want = plain_groups(rows, like)
    assert len({c for _, _, c in want}) == 2
    for _ in range(4):
        rng.shuffle(order := list(range(len(rows))))
        got = ngram_join.similar_groups(spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").coalesce(1), like).collect()
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_null_keys_in_the_join(spark):
    rows = [(None, "a b c d e f"), (None, "only me here now then"), (5, "a b c d e f"), (6, "A B C D E F")]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["component_id"] or 0) for r in got) == [(0, 0), (0, 5), (5, 5), (6, 5)]


def test_overlaps_of_long_and_short_lists():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(80)]
    common = ngram_join.overlaps(sets)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(80) for j in range(i + 1, 80))


# language


def test_languages(spark, sf_dir, odd):
    told = queries.op10_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in told if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in told)
    model = language.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = both(odd, lambda d: language.identify(d, model))
    by = {r["doc_id"]: r for r in rows}
    assert [by[i]["lang_pred"] for i in (1, 2, 6)] == ["und"] * 3 and by[4]["lang_pred"] in model.languages and by[1]["rest"] == 1
    # the text may be named like a column of the answer, or in other letters, and goes along only if it can
    plain = odd.select("doc_id", "text")
    told = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(plain, model).collect()}
    for name in ("score", "Body"):
        renamed = language.identify(plain.withColumnRenamed("text", name), model, text=name.lower())
        assert renamed.columns == (["doc_id", "lang_pred", "score"] if name == "score" else ["doc_id", "Body", "lang_pred", "score"])
        assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in renamed.collect()} == told
    nobody = language.train(odd.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, nobody).collect()} == {"und"}
    alone = language.train(odd.where("lang = 'de'"))
    assert {r["lang_pred"] for r in language.identify(odd, alone).collect()} == {"und", "de"}


def test_ngram_counts_do_not_depend_on_chunks(monkeypatch):
    text, t = "".join(chr(97 + i * i % 26) for i in range(1000)), language.Training(buckets=256)
    whole = language.counts(text, t)
    monkeypatch.setattr(language, "CHUNK", 7)
    assert np.array_equal(whole, language.counts(text, t)) and whole.sum() == 1000 + 999 + 998


def test_copies_neither_starve_nor_flood_the_languages(spark):
    rng, t = np.random.default_rng(8), language.Training(sample=100)

    def text(letters):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(12))

    copied, few, same = text("abcde"), [text("klmno") for _ in range(2)], text("vwxyz")
    rows = [(text("abcde"), "a") for _ in range(500)] + [(copied, "a")] * 5000
    rows += [(text("fghij"), "f") for _ in range(500)] + [(x, "k") for x in few for _ in range(1500)] + [(same, "v")] * 3000
    model = language.train(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert model.facts["sample"] == 501 + 500 + 2 + 1
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = language.train(frame, training=t)
    assert model.languages == ["a", "f", "k", "v"] and 130 < model.facts["sample"] - 3 < 270
    told = language.identify(frame, model).distinct().collect()
    assert {r["lang_pred"] for r in told if r["lang"] in "kv"} == {"k", "v"} and np.mean([r["lang"] == r["lang_pred"] for r in told]) > 0.99
