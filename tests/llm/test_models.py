"""Matching, quality, toxicity, vectors, wrappers, lists and shards on small tables."""

import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest

from flowsieve.llm import decontaminate, neighbour_graphs, quality, shards, toxicity, url_filter, wrappers
from flowsieve.llm.queries import ORACLE_SQL, QUERIES
from tests.parity import connect, differences

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, evidence double, path string, n bigint"


def edit_distance_in(pattern, text):
    above = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (a != b)))
        above = row
    return min(above)


def changed(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at:at + rng.randrange(2)] = rng.choice(["", "q", "zz"[:1]])
    return "".join(out)


def test_pieces_find_what_full_comparison_finds(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for i in range(12)] + [(50, None), (None, "no id here"), (51, "!!"), (0, None)]
    items += [items[0]]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(10)]
    for i, text in items[:12]:
        for share in (0, 0.05, 0.1, 0.2):
            texts.append(f"Start {texts[i % 10][:50]} -- {changed(rng, text, int(share * len(text))).upper()}! {texts[3][:40]}")
    rows = [(i, t, *[None] * 6) for i, t in enumerate(texts)] + [(None, items[0][1], *[None] * 6), (900, None, *[None] * 6), (901, "", *[None] * 6)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id bigint, text string")
    want = set()
    for doc, text, *_ in rows:
        plain = decontaminate.normal(text)
        for item, pattern in set(items[:12]):
            pattern = decontaminate.normal(pattern)
            distance = edit_distance_in(pattern, plain)
            if distance <= int(0.1 * len(pattern)):
                want.add((doc, item, distance))
    got = decontaminate.matched_items(docs, bench).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want and len(got) == len(want) and want
    exact = [r for r in got if r.distance == 0 and r.doc_id is not None]
    assert all(decontaminate.normal(texts[r.doc_id][r["first"]:r["last"]]) == decontaminate.normal(dict(items[:12])[r.item_id]) for r in exact)
    clean = docs.where(~decontaminate.contaminated(docs["text"], bench))
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {w[0] for w in want}
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.matched_items(docs, nothing).count() == 0
    assert docs.where(~decontaminate.contaminated(docs["text"], nothing)).count() == len(rows)
    assert decontaminate.matched_items(spark.createDataFrame([], DOCS), bench).count() == 0


def test_a_match_outside_the_basic_plane_keeps_places():
    matcher = decontaminate.Matcher([(1, "Die Größe des Hauses war enorm")])
    text = "😀😀 x. DIE GRÖSSE, des Hauses: war enorm!"
    (item, distance, _, first, last), = matcher.matches(text)
    assert item == 1 and distance == edit_distance_in("die größe des hauses war enorm", decontaminate.normal(text)[first:last]) > 0


def brute_segments(scores):
    """All maximal segments by splitting at the best one, again and again."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            total = sum(scores[a:b])
            if total > 1e-12 and (best is None or total > best[0] + 1e-12 or abs(total - best[0]) <= 1e-12 and b - a < best[2] - best[1]):
                best = (total, a, b)
    if best is None:
        return []
    _, a, b = best
    return brute_segments(scores[:a]) + [best] + [(s, x + b, y + b) for s, x, y in brute_segments(scores[b:])]


@pytest.mark.parametrize("seed", range(40))
def test_segments_are_all_maximal_ones(seed):
    rng = random.Random(seed)
    scores = [rng.uniform(-2, 2) for _ in range(rng.randrange(25))]
    got = toxicity.maximal_segments(np.array(scores, dtype=float))
    want = brute_segments(scores)
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
    assert all(math.isclose(g[0], w[0]) for g, w in zip(got, want))


def corpus(rng, n=400):
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rude = [f"zork{rng.choice('abcdefghij')}{rng.randrange(90)}" for _ in range(60)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 120))
        toxic = int(rng.random() < 0.2)
        for _ in range(5 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude))
        good = int(rng.random() < 0.7)
        text = " ".join(words) if good else " | ".join(w.upper() for w in words)
        docs.append((i, text, rng.choice(["en", "de", None]), f"s{min(rng.randrange(12), 4)}", len(text), 0.5, "x", 3))
        labels.append((i, good, toxic))
    return docs, labels


ODD = [(9001, None, "en", "s1", None, None, None, None), (9002, "", None, None, 0, None, None, None), (None, "plain words", "en", "s1", 1, None, None, None),
       (9003, "word " * 30_000, "en", "s0", 1, 1.0, "p", 1), (9003, "word " * 30_000, "en", "s0", 1, 1.0, "p", 1)]


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = corpus(random.Random(11))
    noisy = labels + [(None, 1, 1), (3, None, None), (77777, 1, 0), labels[0]]
    return (spark.createDataFrame(docs + ODD, DOCS).cache(), spark.createDataFrame(noisy, "doc_id bigint, quality int, toxic int").cache(), dict(
        (d, (q, t)) for d, q, t in labels))


def test_toxic_texts_are_found_among_held_out_ones(spark, labelled):
    docs, labels, truth = labelled
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.doc_id in truth and r.held_out]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id][1] for r in held) >= 0.95 * len(held)
    assert all(r.predicted == 0 for r in rows if r.doc_id not in truth)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)


def test_passages_are_parts_of_texts(spark, labelled):
    docs, labels, truth = labelled
    model = toxicity.fit(docs, labels)
    found = toxicity.passages(docs, model).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert found and all(texts[r.doc_id][r["first"]:r["last"]] == r.passage for r in found)
    strongest = {}
    for r in sorted(found, key=lambda r: r.evidence):
        strongest[r.doc_id] = r.passage
    toxic = [d for d, (_, t) in truth.items() if t]
    assert sum("zork" in strongest.get(d, "").lower() for d in toxic) >= 0.95 * len(toxic)


def test_toxicity_without_labels_or_rows(spark, labelled):
    docs, labels, _ = labelled
    assert {r.predicted for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_quality_keeps_good_and_drops_bad(spark, labelled):
    docs, labels, truth = labelled
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.kept == bool(truth[r.doc_id][0]) for r in rows if r.doc_id in truth)
    kept = quality.good_rows(docs, labels)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if r.kept)
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.quality(docs, labels.limit(0)).where("kept").count() == len(rows)


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [("big", "a", 8.0)] * 200 + [("big", "b", -8.0)] * 200 + [("bad", "a", -8.0)] * 300 + [("tiny", "a", 0.0)] * 2
    evidence = spark.createDataFrame(rows, "host string, path string, evidence double")
    rates, rate, host_weight, path_weight = quality.site_rates(evidence)
    met = rates.crossJoin(spark.createDataFrame([(0.0,)], "evidence double"))
    score = {(r.host, r.path): r.s2 for r in met.select("host", "path", quality.site_score(rate, host_weight, path_weight).alias("s2")).collect()}
    assert score["bad", "a"] < score["tiny", "a"] < score["big", "a"] and abs(score["tiny", "a"] - 0.5) < 0.2


def test_vectors_link_as_brute_force_says(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(500, 16)).astype(np.float32)
    cluster = base[:1] + 0.05 * rng.normal(size=(150, 16)).astype(np.float32)
    pairs = base[100:140] + 0.12 * rng.normal(size=(40, 16)).astype(np.float32)
    vectors = np.concatenate([base, cluster, pairs, base[:3], base[5:6] * 3])
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(-1, None), (-2, [0.0] * 16), (-3, [float("nan")] * 16), (-4, [float("inf")] + [1.0] * 15), (-5, []), (-6, [1.0, None] + [1.0] * 14), (-7, [1.0, 2.0])]
    odd.append((None, rows[0][1]))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "vec_id bigint, embedding array<float>, h1 string, n_links int")
    got = neighbour_graphs.near_vectors(df, shard_bytes=12_800).collect()
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9 - 1e-12
    true, found = near.sum() - len(vectors), sum(r.n_links for r in got)
    assert 0.98 * true <= found <= true
    tops = list(range(len(vectors)))
    for i, j in zip(*np.nonzero(near)):
        a, b = tops[i], tops[j]
        if a != b:
            tops = [min(a, b) if t in (a, b) else t for t in tops]
    by_id = {r.vec_id: r for r in got}
    assert sum(by_id[i].component_id != t for i, t in enumerate(tops)) <= 0.01 * len(tops)
    assert all(by_id[i].n_links == 0 and by_id[i].component_id == i and by_id[i].kept for i, _ in odd[:-1])
    assert by_id[None].component_id is None and not by_id[None].kept
    assert neighbour_graphs.near_vectors(df.limit(0)).count() == 0


def page(i, extra="", tail="</article></main><footer>&copy; site</footer></body></html>"):
    return (f"<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=/>Home</a><li>Two</ul></nav>"
            f"<div class='cookie-notice'>We use cookies</div><main><article><h1>Title {i}</h1><div class=ad>Buy</div><p>First &amp; <b>bold<p>Second\n &eacute; {i}"
            f"{extra}<form><p>Mail</p></form>{tail}")


def test_main_text_of_one_host(spark):
    rows = [(i, f"http://A.example.com/{i}", page(i, "<p>more" * (i % 3)), "text", 1) for i in range(9)]
    rows += [(100, "http://b.example.org/x", None, "t", 1), (101, None, "", "t", 1), (102, "nonsense", "just <i>text", "t", 1), rows[0],
             (None, "http://A.example.com/z", page(77), "t", 1), (103, "http://c.example.net/", "<div>" * 3000 + "deep" + "</div>" * 3000, "t", 1),
             (104, "http://d.example.net/", page(5, "<p>long text " * 20_000, ""), "t", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    got = wrappers.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    for i in range(9):
        assert by_id[i] == f"Title {i}\nFirst & bold\nSecond é {i}" + "\nmore" * (i % 3)
    assert by_id[None] == "Title 77\nFirst & bold\nSecond é 77"
    assert by_id[100] == "" and by_id[101] == "" and by_id[102] == "just text" and by_id[103] == "deep"
    assert by_id[104].count("\nlong text") == 20_000
    assert wrappers.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [3, 56, 57, 58, 90, 400])
def test_nothing_is_lost_after_deep_elements(spark, depth):
    html = (f"<body><div class=wrap><div class=page><article><p>first{'<div>' * depth}<ul><li>deep<li>deeper</ul>{'</div>' * depth}"
            f"<p>after one</p><section><p>after two</p></section></article></div></div><footer><p>end</p></footer>")
    df = spark.createDataFrame([(1, "http://x.example.com/", html)], "page_id bigint, url string, html string")
    assert wrappers.extract(df).first().text == "first\ndeep\ndeeper\nafter one\nafter two"


def test_long_and_unclosed_attribute_values(spark):
    pages = [f"<article><p data-x=\"{'<b>no ' * 40_000}\">one</p><p title='a>b'>two</p></article>",
             "<article><p title=\"x>one</p><p>it's two</p></article>"]
    df = spark.createDataFrame([(i, f"http://h{i}.example.com/", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    assert [r.text for r in wrappers.extract(df).orderBy("page_id").collect()] == ["one\ntwo", "one\nit's two"]


def test_unmarked_articles_comments_and_sidebars(spark):
    def other(i):
        return (f"<body class='has-sidebar'><header class=site><h1>Site</h1></header><div class=body{i % 2}><h2>Title {i}</h2><p>Para {i} is long enough to count.</p>"
                + f"<h3>Part {i}</h3><p>x {i}</p>" * (i % 3) + f"<ul><li>one {i}<li>two {i}</ul></div><aside><p>Related</p></aside><div id=comments><p>Nice {i}, really long comment text "
                f"that goes on and on and on</p></div><div><a href=x>link one</a> <a href=y>link two {i}</a></div><footer>c {i}</footer></body>")
    df = spark.createDataFrame([(i, "http://x.example.com/", other(i)) for i in range(8)], "page_id bigint, url string, html string")
    for r in wrappers.extract(df).collect():
        i = r.page_id
        assert r.text == f"Title {i}\nPara {i} is long enough to count." + f"\nPart {i}\nx {i}" * (i % 3) + f"\none {i}\ntwo {i}"


def test_copies_of_one_page_keep_their_text(spark):
    df = spark.createDataFrame([(i, "http://x.example.com/", "<div><h2>T</h2><p>always the same text") for i in range(20)], "page_id bigint, url string, html string")
    assert {r.text for r in wrappers.extract(df).collect()} == {"T\nalways the same text"}


def test_wrapper_is_a_union_free_expression():
    streams = []
    for kids in ("<p>a<p>b", "<p>a", "<h2>t</h2><p>a<p>b<table><tr><td>1</table>"):
        root = wrappers.parse(f"<article>{kids}</article>")
        wrappers.fold(root)
        streams.append(wrappers.shape(root))
    whole = streams[0]
    for one in streams[1:]:
        whole = wrappers.align(whole, one)
    assert wrappers.text_form(whole) == ("<page><article>(<h2>#</h2>)?(<p>#</p>)+(<table><tr><td>#</td></tr></table>)?</article></page>")
    assert [wrappers.slots_of(whole, s) for s in streams] == [[1], [1], [0, 1, 2]]


def test_hosts_with_many_templates_take_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "CHUNK", 4)
    shapes = [(f"h{i % 2}", f'["page",[["article",[{",".join(["[" + chr(34) + t + chr(34) + ",[[" + chr(34) + "#" + chr(34) + ",[],0,0]],0,0]" for t in sorted({"p", f"h{1 + i % 6}", f"x{i % 5}"})])}],0,0]],0,0]', 1 + i) for i in range(40)]
    got = wrappers.infer_wrappers(spark.createDataFrame(shapes, "host string, stream string, pages bigint")).collect()
    assert {r.host: r.pages for r in got} == {h: sum(n for g, _, n in shapes if g == h) for h in ("h0", "h1")}


def day(month, number):
    return datetime.date(2024, month, number)


def test_lists_hold_between_their_dates(spark):
    entries = [("a", "domain", "Example.com", "block", day(1, 10)), ("a", "domain", "example.com", "remove", day(2, 1)),
               ("b", "host", "news.example.com", "block", day(1, 1)), ("c", "prefix", "news.example.com/ok", "allow", day(1, 5)),
               ("a", "domain", "example.com", "block", day(3, 1)), ("a", "domain", "example.com", "block", day(3, 1)), (None, "host", "x.org", "block", day(1, 1)),
               ("d", "host", None, "block", day(1, 1)), ("e", "host", "same.org", "block", day(1, 1)), ("e", "host", "same.org", "remove", day(1, 1))]
    asked = [(1, "http://EXAMPLE.com/", day(1, 9)), (2, "http://example.com/", day(1, 10)), (3, "http://a.b.example.com./x", day(1, 31)),
             (4, "http://example.com/", day(2, 1)), (5, "https://u:p@news.example.com:80/ok/page?q=1", day(1, 6)), (6, "https://news.example.com/okay", day(1, 6)),
             (7, "https://news.example.com/ok", day(1, 12)), (8, "http://notexample.com/", day(1, 12)), (9, None, day(1, 12)), (10, "http://example.com/", None),
             (11, "no url", day(1, 12)), (12, "http://same.org/", day(5, 1)), (2, "http://example.com/", day(1, 10)), (None, "http://example.com/", day(3, 5)),
             (13, "http://" + ".".join("a" * 3000) + "/" + "x/" * 20_000, day(1, 12))]
    captures = spark.createDataFrame([(*a, "z", "k", False) for a in asked], "page_id bigint, url string, fetched_on date, day string, row string, blocked boolean")
    dated = spark.createDataFrame(entries, "list string, kind string, pattern string, action string, changed_on date")
    got = url_filter.judge(captures, dated).collect()
    assert sorted(((r.page_id, r.n_active, r.blocked) for r in got), key=repr) == sorted([
        (1, 0, False), (2, 1, True), (3, 1, True), (4, 0, False), (5, 2, False), (6, 1, True), (7, 3, False), (8, 0, False), (9, 0, False),
        (10, 0, False), (11, 0, False), (12, 0, False), (2, 1, True), (None, 1, True), (13, 0, False)], key=repr)
    assert {r.reason for r in got if r.page_id == 7} == {"c:prefix:news.example.com/ok"}
    assert url_filter.judge(captures.limit(0), dated).count() == 0
    assert not any(r.blocked for r in url_filter.judge(captures, dated.limit(0)).collect())


def test_shards_are_exact_and_whole(spark):
    rows = [(i % 700, None if i % 50 == 0 else f"t{i % 300}", 1, "p", 0) for i in range(1000)] + [(None, None, 1, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, part string, slot int").repartition(7)
    got = shards.uniform_shards(df, 16, block_rows=20).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    sizes = sorted(map(len, by_shard.values()))
    assert len(sizes) == 16 and sizes[-1] - sizes[0] <= 1 and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert shards.uniform_shards(df.limit(0), 16).count() == 0


def test_matrix_has_the_margins_and_law_of_a_shuffle():
    rows, targets = [30, 0, 50, 20], shards.near_equal(100, 7)
    total = np.zeros((4, 7))
    for seed in range(400):
        matrix = np.array(shards.communication_matrix(rows, targets, seed))
        assert matrix.sum(1).tolist() == rows and matrix.sum(0).tolist() == targets and (matrix >= 0).all()
        total += matrix
    expected = np.outer(rows, targets) / 100
    assert np.abs(total / 400 - expected).max() < 0.4


def test_hypergeometric_draws_follow_their_law():
    rng, draws = random.Random(1), Counter()
    for _ in range(20_000):
        draws[shards.hypergeometric(rng, 6, 9, 5)] += 1
    for k in range(6):
        p = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(draws[k] / 20_000 - p) < 0.015
    assert 480_000_000 < shards.hypergeometric(rng, 10**10, 10**10, 10**9) < 520_000_000


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert differences(QUERIES[name](spark, folder), connect(folder), ORACLE_SQL[name]) == []
