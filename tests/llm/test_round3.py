"""Centroids, dialogue repair and suffix dedup against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tapewright.llm import centroids, dialogue, html, queries, spans, suffixes

# -- suffixes


def brute_kept(texts, least):
    counts = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - least + 1):
            if counts[t[i : i + least]] > 1:
                gone[i : i + least] = [True] * least
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((bytes(b for b, g in zip(t, gone) if not g), sum(gone), runs))
    return out


def passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    base = " ".join(word() for _ in range(700))
    texts = []
    for _ in range(50):
        t = " ".join(word() for _ in range(r.randint(0, 80)))
        for _ in range(r.randint(0, 4)):
            i = r.randint(0, len(base) - 1)
            t += base[i : i + r.choice([150, 190, 199, 200, 201, 230, 300, 500, 1500])] + word()
        texts.append(t)
    return [*texts, texts[5], texts[5], "x" * 150, "y" * 430, "z" * 200, "", "ab" * 300, base]


@pytest.mark.parametrize(("seed", "least"), [(1, 200), (2, 70)])
def test_repeated_bytes_match_brute_force(spark, seed, least):
    texts = passages(seed)
    rows = [(i, t, 7, "a") for i, t in enumerate(texts)] + [(3, None, 7, "a"), (None, texts[5], 7, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, `k.b c` string")
    got = suffixes.drop_repeated_bytes(df, least)
    assert got.columns == ["doc_id", "text", "k.b c", "kept", "n_bytes", "n_removed", "n_spans"]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "", bytes(r.kept or b""), r.n_bytes, r.n_removed, r.n_spans) for r in got.collect())
    all_texts = [(r[0] if r[0] is not None else -1, r[1] or "") for r in rows]
    want = brute_kept([t.encode() for _, t in all_texts], least)
    assert got == sorted((i, t, k, len(t.encode()), n, s) for (i, t), (k, n, s) in zip(all_texts, want))
    assert sum(x[4] for x in got) > 1000


def test_chunks_of_a_long_text_rank_the_same_places(monkeypatch):
    text = passages(3)[-1].encode() * 3 + b"q" * 700
    for length, part in ((64, 32), (192, 128), (200, 192)):
        whole = [np.concatenate(x) for x in zip(*suffixes._ranked(text, length, part, 200))]
        monkeypatch.setattr(suffixes, "CHUNK", 97)
        parts = [np.concatenate(x) for x in zip(*suffixes._ranked(text, length, part, 200))]
        monkeypatch.undo()
        assert all((a == b).all() for a, b in zip(whole, parts))


def test_every_string_holds_a_sampled_place():
    names = np.random.default_rng(1).integers(1, 9, 500, dtype=np.uint64)
    for width in (1, 2, 9, 137):
        at = set(suffixes.sampled(names, width).tolist())
        assert at == {i for s in range(len(names) - width + 1) for i in range(s, s + width) if names[i] == names[s : s + width].min()}


def test_suffixes_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.drop_repeated_bytes(empty).collect() == []


# -- centroids


def brute_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]
    now = [v for _, v in start]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min((far(v, c), n) for n, c in enumerate(now)) for _, v in kept]
    for _ in range(rounds):
        placed = assign()
        for n in range(len(now)):
            own = [v for (_, v), (_, m) in zip(kept, placed) if m == n]
            if own:
                now[n] = [sum(x) // len(own) for x in zip(*own)]
    placed = assign()
    inertia = Counter()
    for d, n in placed:
        inertia[n] += d
    return Counter((i, n, d, tuple(now[n]), inertia[n], sum(inertia.values())) for (i, _), (d, n) in zip(kept, placed))


@pytest.mark.parametrize("rewrite", [0.0, 0.25, 2.0])
def test_clusters_match_brute_force(spark, rewrite):
    r = random.Random(5)
    centres = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in r.choice(centres)]) for i in range(120)]
    rows += [(7, rows[3][1]), (7, rows[4][1]), (None, rows[5][1]), (200, None), (201, [0.5] * 63), (202, [float("nan")] + [0.0] * 63), (203, [None] + [0.0] * 63), (204, [float("inf")] + [0.0] * 63), (205, [0.0] * 64)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, cluster string")
    got = Counter((x.vec_id, x.cluster, x.distance, tuple(x.centroid), x.cluster_inertia, x.inertia) for x in centroids.cluster_vectors(df, rewrite=rewrite).collect())
    assert got == brute_clusters(rows)


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((x.vec_id, x.cluster, x.distance, tuple(x.centroid), x.cluster_inertia, x.inertia) for x in centroids.cluster_vectors(df).collect())
    assert got == brute_clusters(rows)
    assert centroids.cluster_vectors(df.limit(0)).collect() == []
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    assert {x.distance for x in centroids.cluster_vectors(huge).collect()} == {0}


# -- dialogue

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def brute_audit(codes):
    """All cheapest audits by search, and of these the first; codes as in dialogue.moves."""
    n, far = len(codes), 10**9

    def steps(i, state):
        for role in "ua":
            if role in NEXT[state]:
                yield "I", 5, i, NEXT[state][role]
        if i < n:
            yield "D", 2, i + 1, state
            if codes[i] != "x":
                extra = 5 * codes[i].isupper()
                if codes[i].lower() in NEXT[state]:
                    yield "K", extra, i + 1, NEXT[state][codes[i].lower()]
                for role in "ua":
                    if role in NEXT[state]:
                        yield "R", 1 + extra, i + 1, NEXT[state][role]

    left = {(n, s): (0 if s in (0, 3) else far) for s in range(4)}
    left |= {(i, s): far for i in range(n) for s in range(4)}
    for _ in range(5 * (n + 2)):
        for i, s in left:
            left[i, s] = min([left[i, s], *(c + left[j, t] for _, c, j, t in steps(i, s))])
    found = []

    def walk(i, s, edits):
        if i == n and s in (0, 3) and left[i, s] == 0:
            found.append(edits)
        for e, c, j, t in steps(i, s):
            if c + left[j, t] == left[i, s] and left[i, s] < far:
                walk(j, t, edits + e)

    walk(0, 0, "")
    return left[0, 0], min(found)


def audit_of(codes, costs=dialogue.Costs()):
    end = dialogue.crossing(dialogue.forward(codes, dialogue.only(0), costs), dialogue.tail_costs(costs))
    return "".join(e for _, e in dialogue.solve(codes, 0, end, costs)) + dialogue.finish(end)


def test_audits_match_search():
    r = random.Random(8)
    for _ in range(400):
        codes = "".join(r.choice("suaouaSUAOx") for _ in range(r.randint(1, 8)))
        assert audit_of(codes) == brute_audit(codes)[1], codes


def test_borders_of_pieces_give_the_same_audit():
    r, costs = random.Random(9), dialogue.Costs()
    for _ in range(200):
        codes = "".join(r.choice("suaoUAx") for _ in range(r.randint(2, 40)))
        parts = [codes[i : i + 3] for i in range(0, len(codes), 3)]
        measured = []
        for p in parts:
            ways = [dialogue.forward(p, dialogue.only(s), costs) for s in range(4)]
            measured.append(([c for w in ways for c, _ in w], [x for w in ways for _, x in w]))
        at = dialogue.borders(measured, costs)
        joined = "".join(e for p, x, y in zip(parts, at, at[1:]) for _, e in dialogue.solve(p, x, y, costs)) + dialogue.finish(at[-1])
        assert joined == audit_of(codes)


def brute_repair(rows):
    """rows: (conv_id, turn, role, text), of which no two share a turn but equal ones."""
    shown = lambda x: " " if x is None else str(x)
    by = {}
    for conv, turn, role, text in rows:
        own = by.setdefault(conv, [])
        fault = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        own += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        turns = {t for t, _, _ in own if t is not None}
        seen, faults, codes = set(), [], ""
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            code = role[:1] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if faults[-1] in ("blank", "duplicate") else code.upper() if faults[-1] else code
        cost, audit = brute_audit(codes)
        lines, state, at = [], 0, 0
        for e in audit:
            if e == "I":
                role = "a" if state == 2 else "u"
                lines.append({"u": "user:", "a": "assistant:"}[role])
                state = NEXT[state][role]
                continue
            _, role, text = own[at]
            if e != "D":
                now = role[:1] if e == "K" else "a" if state == 2 else "u"
                lines.append((role if e == "K" else {"u": "user", "a": "assistant"}[now]) + ":" + text)
                state = NEXT[state][now]
            at += 1
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations():
    r = random.Random(4)
    rows = []
    for conv in range(60):
        for turn in range(r.randint(1, 7)):
            if r.random() < 0.9:
                role = r.choice(["user", "assistant"]) if r.random() < 0.4 else ["user", "assistant"][turn % 2] if turn or r.random() < 0.7 else "system"
                rows.append((conv, turn * r.choice([1, 1, 1, 3]) + 50 * turn, role, r.choice(["Yes.", "no", "Why? ", "éa!\n", " \t", "said twice.", f"text {turn}."])))
    lost = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows += [(lost, 1, "user", "Gone."), (None, 1, "user", "hi."), (None, 2, "assistant", None), (None, 3, "assistant", "ho."), (900, None, "user", "a."), (901, 1, None, "a."), (902, 5, "", "b!"), (903, 1, "tool", "x."), (903, 2, "tool", "y."), (904, 3, "user", "word " * 40_000 + ".")]
    return rows


def check_repair(spark, rows):
    df = spark.createDataFrame([(*x, "f") for x in rows], "conv_id long, turn long, role string, text string, fault string")
    summary = dialogue.repair_summary(dialogue.repaired_rows(dialogue.damaged(df)))
    assert summary.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(x) for x in summary.collect()]
    assert len(got) == len({x[0] for x in got})
    assert {x[0]: x[1:] for x in got} == brute_repair(rows)


def test_repair_matches_brute_force(spark):
    rows = conversations()
    want = brute_repair(rows)
    assert any(w[-1] == hashlib.sha256(b"").hexdigest() and not w[-2] for w in want.values())  # a conversation that lost all rows
    check_repair(spark, rows)


def test_a_conversation_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(dialogue, "PIECE", 2)
    r = random.Random(6)
    df = spark.createDataFrame([(1, t, r.choice(["user", "assistant", "assistant", "tool"]), r.choice(["a.", "b", "c.", "d?"]) + f" {t % 90}" * (t % 2)) for t in range(300)], "conv_id long, turn long, role string, text string")
    rows = dialogue.damaged(df)
    split = {x.conv_id: tuple(x) for x in dialogue.repair_summary(dialogue.repaired_rows(rows)).collect()}
    monkeypatch.undo()
    assert split == {x.conv_id: tuple(x) for x in dialogue.repair_summary(dialogue.repaired_rows(rows)).collect()}


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair_summary(dialogue.repaired_rows(dialogue.damaged(empty))).collect() == []


def test_queries_cover_their_tables(spark):
    sf = "/root/testdata/sf0.001"
    registered = queries.queries()
    assert registered["op11_centroids"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert registered["op12_dialogue_repair"](spark, sf).count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    assert registered["op13_suffix_dedup"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


@pytest.mark.parametrize("name", ["op11_centroids", "op13_suffix_dedup"])
def test_query_matches_sql(spark, name):
    import duckdb

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    found = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(found.fetchall()) == sorted(tuple(r[c] for c in columns) for r in df.collect())


# -- pages


def story(i, extra=""):
    own = " ".join(f"word{i}x{k}" for k in range(60))
    return f"<html><body><div id='wrap'><article><h1>Story {i}</h1><p>{own}</p>{extra}</article></div></body></html>"


def extracted(spark, sources, host="news.example"):
    rows = [(i, f"https://{host}/{i}", s) for i, s in enumerate(sources)]
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_blocks_that_a_few_articles_share_stay(spark):
    """Three stories of one host, and thirty of another of which five share their blocks."""
    common = "<h2>Conclusion</h2><p>Yes.</p><ul><li>Salt</li></ul>"
    for got in (extracted(spark, [story(i, common) for i in range(3)]), extracted(spark, [story(i, common if i < 5 else "") for i in range(30)])):
        assert all(got[i].endswith("Conclusion Yes. Salt") for i in range(3))


def test_notices_on_most_articles_go_and_headings_stay(spark):
    notice = "<h2>About</h2><p>All rights are reserved by the paper and its authors.</p><p>So there.</p>"
    got = extracted(spark, [story(i, notice if i % 4 else "") for i in range(12)])
    assert got[1].endswith("About") and all("rights" not in t and "there" not in t for t in got.values())


def test_templates_equal_a_count_by_hand(spark):
    """Containers outside articles go from 3 different pages of a host on, whatever they are called."""
    page = lambda i, box: f"<html><body><div>{box}</div><div><p>{' '.join(f'w{i}k{k}' for k in range(40))}</p></div></body></html>"
    boxes = ["shared by three", "shared by two"]
    sources = [page(i, boxes[0] if i < 3 else boxes[1] if i < 5 else f"own {i}") for i in range(7)]
    got = extracted(spark, sources)
    assert ["shared" in got[i] for i in range(7)] == [False] * 3 + [True] * 2 + [False] * 2 and "own 5" in got[5]


def test_plain_words_mark_no_paragraphs_inside_an_article():
    source = "<article><header><h1>Title</h1></header><p>a</p><section class='notice'>legal</section><p class='share'>share price fell</p><div class='ad'>buy</div><p hidden>no</p><header class='banner'><h2>x</h2></header></article>"
    assert html.Page(source).text() == "Title a legal share price fell"


# -- spans


def test_a_passage_that_says_one_thing_over_and_over_is_found(spark):
    r = random.Random(12)
    lead = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(80)) + ". "
    listed = " ".join(f"item {i} price euro net" for i in range(20))
    docs = [(1, lead() + listed), (2, lead() + listed + ". " + lead()), (3, lead() + " ".join(f"item {i} price euro net" for i in range(300, 320)))]
    got = {x.doc_id: x.n_words_removed for x in spans.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == got[3] == 0 and got[2] >= 84


def spread(windows, n, least):
    """Places in any of the windows of `least` words that begin at these places."""
    out = np.zeros(n, bool)
    for k in windows:
        out[k : k + least] = True
    return out


def said_earlier(texts, i, least):
    """Places in text i in windows of `least` words that an earlier text holds, or text i itself before the window begins."""
    grams = lambda t: {tuple(t[k : k + least]): k for k in reversed(range(len(t) - least + 1))}
    before, own, t = set().union(*map(grams, texts[:i])), grams(texts[i]), texts[i]
    return spread([k for k in range(len(t) - least + 1) if (g := tuple(t[k : k + least])) in before or own[g] + least <= k], len(t), least)


def test_op7_leaves_out_neither_words_said_to_no_end_nor_repeats_inside_a_document(spark, tmp_path):
    r = random.Random(70)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    listed = [f"{x}" for i in range(14) for x in ("item", f"i{i}", "price", "euro", "net")]
    pool = [["the"] * 90, ["buy", "now"] * 40, listed[:55], listed, fresh(60), fresh(51), [x for i in range(9) for x in ["so", f"s{i % 3}"] * 4]]
    texts = [sum((r.choice(pool) if r.random() < 0.5 else fresh(r.randrange(3, 30)) for _ in range(8)), []) for _ in range(12)]
    block = fresh(60)
    texts = [fresh(200), fresh(20) + ["the"] * 90, ["the"] * 70 + fresh(9), block + fresh(30) + block, *texts, [], fresh(5)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (None, " ".join(block + block))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in queries.op7_span_dedup(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        long, some = said_earlier(texts, i, 50), said_earlier(texts, i, spans.LEAST_WORDS)
        # At most REACH words stay at either end.
        inner = sum(all(long[max(0, k - spans.REACH) : k + spans.REACH + 1]) for k in range(len(t)) if spans.REACH <= k < len(t) - spans.REACH)
        assert inner <= got[i].n_words_removed <= some.sum(), i
        assert len(got[i].text.split()) == len(t) - got[i].n_words_removed
    assert got[0].text == docs[0][1] and got[90].text == "" and got[None].text == docs[-1][1]
    # Of what a document alone repeats, the first stays.
    assert got[2].n_words_removed >= 54 and got[3].n_words_removed >= 44 and got[3].text.startswith(" ".join(block))
