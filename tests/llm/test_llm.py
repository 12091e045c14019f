import base64
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligaquery import session
from ligaquery.llm import bpe, packing, percentiles, truncation

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
needs_ranks = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary")

# ---- tokens ----


@pytest.fixture(scope="module")
def enc():
    with open(RANKS, "rb") as f:
        return bpe.Encoder(f.read())


@pytest.fixture(scope="module")
def known():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(x):
    return np.frombuffer(x, "<i4").tolist()


@needs_ranks
def test_ids_equal_the_public_tokenizer(enc, known):
    rng = random.Random(1)
    letters = list("ab '\n\t\r1é中.\x1c　\x85 😀st") + ["the", " the", "ing"]
    texts = ["", "a" * 5000, "aaa", "  x", "x   ", "'s's'll don't", "ab" * 999, " " * 70, "\x1c a\x1cb", "1234567890" * 99, "<|endoftext|>"]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)]
    assert [ids(x) for x in enc.encode(texts)] == [known.encode_ordinary(t) for t in texts]


@needs_ranks
def test_forgetting_changes_nothing(enc, known, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    for t in ("one two three four five", "six seven one two", "", "eight one"):
        assert ids(enc.encode([t, t])[1]) == known.encode_ordinary(t)


def test_queue_pops_in_order():
    q, rng = bpe.RankQueue(60_000), random.Random(2)
    want = sorted({rng.randrange(60_000) for _ in range(500)})
    for r in rng.sample(want, len(want)):
        q.push(r, np.array([r]))
    q.push(want[7], np.array([1, want[7]]))
    got = []
    while (x := q.pop()) is not None:
        got.append(x[0])
    assert got == want


@needs_ranks
def test_token_ids_frame(spark, known):
    long = "word " * 50_000
    rows = [(1, "hello world"), (2, ""), (3, None), (4, long), (1, "hello world")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").withColumn("out", F.lit(1)).withColumn("row_id", F.lit("clash"))
    got = [(r.doc_id, r.ids) for r in bpe.token_ids(df, "doc_id", "text", RANKS).collect()]
    assert sorted(map(str, got)) == sorted(str((i, known.encode_ordinary(t or ""))) for i, t in rows)
    n = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", "text", RANKS).collect()}
    assert n[2] == n[3] == 0 and n[4] == len(known.encode_ordinary(long))
    assert bpe.token_ids(df.limit(0), "doc_id", "text", RANKS).count() == 0


# ---- packing ----


def test_pack_keeps_every_token(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 60)
    rng = random.Random(3)
    sizes = [(i, rng.choice([None, 0, 1, 5, 50, 64, 65, 128, 700, rng.randint(1, 200)])) for i in range(400)] + [(5, 9), (5, 9), (None, 3)]
    df = spark.createDataFrame(sizes, "doc_id BIGINT, n BIGINT")
    packs = [("a", 64), ("b", 128), ("none", None), ("zero", 0)]
    rows = packing.pack(df, "doc_id", "n", packs).collect()
    assert {r.pack_name for r in rows} == {"a", "b"}
    for name, cap in packs[:2]:
        own, fill = [r for r in rows if r.pack_name == name], defaultdict(int)
        assert sum(r.n_tokens for r in own) == sum(n or 0 for _, n in sizes)
        for r in own:
            assert (r.container_id is None) == (r.n_tokens == 0) and r.first_token == r.piece_no * cap
            fill[r.container_id] += r.n_tokens
        assert max(fill.values()) <= cap
        whole = {i for i, n in sizes if n and 0 < n <= cap and i not in (5, None)}
        assert all(r.piece_no == 0 for r in own if r.doc_id in whole)
        assert sum(r.n_tokens == 0 for r in own) == sum(not n for _, n in sizes)
    f = {r.pack_name: r for r in packing.fill(packing.pack(df, "doc_id", "n", packs)).collect()}
    assert all(r.fullest <= r.capacity and r.containers >= r.least_containers for r in f.values())
    assert packing.pack(df.limit(0), "doc_id", "n", packs).count() == 0 and packing.pack(df, "doc_id", "n", []).count() == 0


def test_little_is_unused():
    rng = np.random.default_rng(5)
    sizes = np.sort(np.minimum(rng.lognormal(5.5, 0.8, 5000).astype(int) + 1, 1024))[::-1]
    for cap in (1024, 2048):
        where = packing.place(sizes, cap)
        assert np.bincount(where, sizes).max() <= cap and where.max() + 1 == len(np.unique(where))
        assert sizes.sum() / ((where.max() + 1) * cap) > 0.99
    assert len(packing.place(np.array([], np.int64), 5)) == 0
    assert packing.place(np.array([7, 7, 7, 1]), 8).tolist() == [0, 1, 2, 0] and packing.place(np.array([5]), 5).tolist() == [0]


def test_least_cost_decides(monkeypatch):
    """Of the open sequences with room the cheapest takes the next item."""
    monkeypatch.setattr(packing, "OPEN", 3)
    rng = random.Random(8)
    sizes = np.array(sorted((rng.randint(1, 100) for _ in range(400)), reverse=True))
    where, boxes = packing.place(sizes, 128), defaultdict(list)
    for s, w in zip(sizes.tolist(), where.tolist(), strict=True):
        boxes[w].append(s)
    assert all(sum(v) <= 128 for v in boxes.values()) and sorted(x for v in boxes.values() for x in v) == sorted(sizes.tolist())
    left = sizes.tolist()
    begin = 0
    while left:
        k = min(3, -(-sum(left) // 128))
        room, cost, after = [128] * k, [0.0] * k, []
        for s in left:
            able = [j for j in range(k) if room[j] >= s]
            if not able:
                after.append(s)
                continue
            j = min(able, key=lambda j: (cost[j], j))
            room[j] -= s
            cost[j] += packing.LINEAR * s + s * s
        for j in range(k):
            if room[j] < 128:
                assert sum(boxes[begin]) == 128 - room[j]
                begin += 1
        left = after


# ---- percentiles ----


@pytest.mark.parametrize("most", [session.BROADCAST_BYTES, -1])
def test_percentiles_random(spark, monkeypatch, most):
    """Also with intervals too many to be broadcast, where one group holds most rows."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", most)
    rng = random.Random(4)
    inf = float("inf")
    values = [None, float("nan"), 0.0, -0.0, 1.5, 1.5, 1e300, -1e300, 5e-324, inf, inf, -inf, 3.25, -7.0]
    rows = [(rng.choice(["a", "a", "a", "b", None]), i % 3, rng.choice(values), rng.gauss(0, 1)) for i in range(900)] + [("solo", 0, 2.0, None), ("void", 0, None, None), ("ends", 0, inf, -inf), ("ends", 1, inf, 3.0), ("ends", 2, 1.0, None)]
    df = spark.createDataFrame(rows, "g STRING, part INT, x DOUBLE, y DOUBLE").withColumn("v", F.lit("clash"))
    parts = percentiles.value_counts(df, ["g"], ["x", "y"], ["part"])
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {(r.g, r.measure, r.p): (r.n, r.value) for r in percentiles.percentiles(percentiles.combined(parts, ["g"]), ["g"], probs).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for m, k in (("x", 2), ("y", 3)):
            v = sorted(r[k] for r in rows if r[0] == g and r[k] is not None and r[k] == r[k])
            for p in probs if v else []:
                h = (len(v) - 1) * p
                i = int(h)
                f = h - i
                j = i + (f > 0)
                want[g, m, p] = (len(v), v[i] if v[i] == v[j] else v[i] * (1 - f) + v[j] * f)
    assert want["ends", "x", 0.5] == (3, inf)
    assert got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(v, rel=1e-12, abs=1e-320, nan_ok=True), k


def test_allowed_error_and_empty(spark):
    rng = random.Random(6)
    xs = [rng.uniform(-50, 50) for _ in range(2001)]
    df = spark.createDataFrame([("g", x) for x in xs], "g STRING, x DOUBLE")
    r = percentiles.percentiles(percentiles.value_counts(df, ["g"], ["x"]), ["g"], [0.5], max_error=0.5).first()
    assert abs(r.value - sorted(xs)[1000]) <= 0.5
    assert percentiles.percentiles(percentiles.value_counts(df.limit(0), ["g"], ["x"]), ["g"], [0.5]).count() == 0


# ---- truncation ----

HEAD = "From: Ana <ana@x.example>\nSubject: note\n\n"


def corpus():
    rng = random.Random(7)
    nouns = ["server", "budget", "draft", "poster", "library", "contract"]
    say = lambda: f"I would rather check the {rng.choice(nouns)} than wait until the {rng.choice(nouns)} was blocked again. Could you rename the {rng.choice(nouns)} this morning?"
    return [(i, HEAD + " ".join(say() for _ in range(3)) + rng.choice(["", "\n\nBest,\nAna"]), rng.choice(["s1", "s2", None])) for i in range(400)]


def complete_parts():
    """Complete texts with encoded parts, 120 of a kind: what their like end in is known from them."""
    say = "Could you rename the server this morning? I would rather check the draft than wait."
    code = base64.b64encode((say * 3).encode()).decode()
    wrapped = "\n".join(code[k : k + 76] for k in range(0, len(code), 76))
    forms = [
        'Content-Type: multipart/mixed; boundary="=_b"\n\n--=_b\n\n' + say + "\n\n--=_b\n\n" + say + "\n--=_b--\n",
        "Content-Transfer-Encoding: base64\n\n" + wrapped + "\n",
        "Content-Transfer-Encoding: quoted-printable\n\nCould you rename the server=\n this morning=3F\nIt is blocked=2E\nThe=\n end.\n",
        "Content-Type: text/html\n\n<html><body>\n<p>" + say + "</p>\n<p>" + say + "</p>\n</body></html>\n",
    ]
    return [(3000 + 200 * k + i, f, "s3") for k, f in enumerate(forms) for i in range(120)]


def test_truncated(spark):
    rows = corpus() + complete_parts()
    body = rows[0][1][:200]
    b64 = base64.b64encode((HEAD + "all is well here.").encode()).decode()
    multi = 'Content-Type: multipart/mixed; boundary="=_b"\n\n--=_b\n\nCould you\n'
    cut = {
        1001: HEAD + "Could you rename the draft this morning? I would rather check the server than wait until the",
        1002: HEAD + "Could you rename the poster this morning? I would rather check the server than wait unt",
        1003: multi,
        1004: "Content-Transfer-Encoding: base64\n\n" + b64[:-3],
        1005: "Content-Transfer-Encoding: quoted-printable\n\nCould you rename the server this morning=",
        1009: "Content-Transfer-Encoding: base64\n\n" + b64[:12] + "...",
        1006: HEAD + "I would rather check the ...",
        1007: "From: a@x.example\nSubj",
        1008: HEAD + "Could you rename the �",
        1010: "Content-Type: text/html\n\n<html><body>\n<p>Could you rename the server this morning?</p>\n",
        1011: 'Content-Type: multipart/mixed; boundary="=_b"\n\n--=_b\n\nI would rather check the draft.\n\n--=_b\n\nCould you rename the server this morning?',
    }
    fine = {
        2001: HEAD + "I would rather check the poster than wait until the draft was blocked again",
        2002: HEAD + "ok",
        2003: multi + "--=_b--\n",
        2004: None,
        2005: "",
        2006: " \n\t ",
        2007: HEAD + "Could you rename the budget this morning?\n\nBest,\nAna",
        2008: HEAD + "x" * 200_000 + ".",
        2009: HEAD,
        2010: "Content-Transfer-Encoding: base64\n\nCould you rename the poster this morning?",
    }
    extra = [(i, t, "s1") for i, t in {**cut, **fine}.items()] + [(1001, cut[1001], "s2")]
    df = spark.createDataFrame(rows + extra, "doc_id BIGINT, text STRING, source STRING").withColumn("body", F.lit("clash")).withColumn("id", F.lit(1))
    found = [r.doc_id for r in truncation.truncated(df, "doc_id", "text", "source").collect()]
    assert sorted(found) == sorted([*cut, 1001]), body
    by = {r.source: r for r in truncation.by_source(df, "doc_id", "text", "source").collect()}
    assert by["s1"].n_cut == len(cut) and by["s2"].n_cut == 1 and by[None].n_cut == 0
    assert sum(r.n_texts for r in by.values()) == len(rows) + len(extra)
    assert truncation.truncated(df.limit(0), "doc_id", "text", "source").count() == 0


def test_more_final_trigrams_than_are_broadcast(spark, monkeypatch):
    """All trigrams are counted, then joined by salted shuffles; the found rows are the same. Long words match as well."""
    tail = "x" * 50
    cut = {1: "Could you rename the draft this morning? I would rather check the server than wait until the", 2: f"Zunur likes {tail}yz"}
    long = [(7000 + i, HEAD + f"Zunur likes {tail}yz{tail} a lot.", "s1") for i in range(60)]
    rows = corpus()[:150] + long + [(i, HEAD + t, "s2") for i, t in cut.items()]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    found = lambda: sorted((r.id, r.by) for r in truncation.evidence(df, "doc_id", "text", "source").where("by IS NOT NULL").collect())
    want = found()
    assert want == [(1, "words"), (2, "words")]
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    assert found() == want


def test_limit_of_a_source(spark):
    """Texts that end at their source's limit, but where any text might, are found by the limit."""
    rows = [(i, t, "free") for i, t, _ in corpus()]
    long = HEAD + "I would rather check the server than wait until the draft was blocked again. " * 9
    n = len(HEAD) + 320
    rows += [(5000 + i, (HEAD + "z" * i + long[len(HEAD):])[:n], "short") for i in range(40)]
    rows += [(6000, (HEAD + "Zqx " * 200)[:n], "short")]
    found = {r.doc_id for r in truncation.truncated(spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING"), "doc_id", "text", "source").collect()}
    assert 6000 in found and not [x for x in found if x < 5000]


def test_cut_in_a_word_after_a_rare_context(spark):
    """A word or an address that breaks off behind words met nowhere else; a rare whole word or address is none."""
    rows = [(i, t, "s1") for i, t, _ in corpus()] + [(5000 + i, HEAD + f"Ask w{chr(97 + i)}x today or n{chr(97 + i)}n@fjarn.invalid soon.", "s1") for i in range(20)]
    cut = {1: "Zunur calls hquarik@fjarn.inva", 2: "Zunur calls lregor@fj", 3: "Zunur likes serv", 4: "Brarik likes serv"}
    fine = {11: "Zunur calls hquarik@fjarn.invalid", 12: "Zunur likes server", 13: "Zunur likes Quorvex", 14: "Zunur calls me@"}
    rows += [(i, HEAD + t, "s2") for i, t in {**cut, **fine}.items()]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    assert sorted(r.doc_id for r in truncation.truncated(df, "doc_id", "text", "source").collect()) == sorted(cut)
