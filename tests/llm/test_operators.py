"""The numbered operators on small tables with nulls, empty texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from careledger.llm import ann, components, exact, html, mixing, ngram_join, packing, quality, sharding, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, n long, gid long"


def long_text(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{rng.integers(0, 5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = long_text(1)
    near = base.split()
    near[30] = "changed"
    rows = [(1, base), (2, base), (3, "  " + base.replace(" ", "\n")), (4, " ".join(near)), (5, ""), (6, None), (7, " \t"), (8, "one two"), (9, "one  two"), (9, "one  two"), (None, "no id"), (10, long_text(2, 30000))]
    rows += [(100 + i, long_text(100 + i)) for i in range(60)]
    return spark.createDataFrame([(i, t, "en", "ab"[k % 2] if k % 5 else None, 0, 7, 8, 9) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_sharding_is_balanced_and_gapless(docs, empty):
    rows = sharding.bounded_ring_shards(docs, "doc_id", 5).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert len(rows) == docs.count() and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.bounded_ring_shards(empty, "doc_id", 5).count() == 0


def test_ring_overflow_moves_clockwise():
    runs = sharding.walk_ring({0: 5, 100: 1}, [(10, 0), (50, 1), (200, 2)], [2, 2, 2])
    assert runs == [(0, 0, 2, 0, 0), (100, 0, 1, 2, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 1)]


def test_exact_groups_match_brute_force(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    want = Counter((i, min(groups[norm(t)])[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    found = exact.exact_dedup(docs).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(groups) == exact.keep_first_copies(docs).count()
    assert exact.exact_dedup(empty).count() == 0


def test_links_and_classes_match_brute_force(docs, empty):
    rows = [(r[0], set(ngram_join.shingles(r[1]).tolist())) for r in docs.select("doc_id", "text").collect()]
    found = ngram_join.ngram_jaccard_join(docs).collect()
    links = Counter()
    for k, (i, s) in enumerate(rows):
        links[(i, sum(1 for m, (_, t) in enumerate(rows) if m != k and s and t and len(s & t) >= 0.8 * len(s | t)))] += 1
    assert Counter((r["doc_id"], r["n_links"]) for r in found) == links
    classes = {r["doc_id"]: r["class_id"] for r in found}
    assert classes[2] == classes[3] == 1 and classes[9] == 8 and classes[5] == 5 and classes[10] == 10
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_a_large_group_of_near_copies_keeps_every_link(spark):
    words = long_text(3, 200).split()
    rows = [(i, " ".join(words[: i % 20] + [f"x{i}"] + words[i % 20 + 1 :])) for i in range(150)] + [(1000, long_text(4, 200))]
    found = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["class_id"] == 0 and r["n_links"] == 149 for r in found if r["doc_id"] < 1000)


def test_one_row_per_class_whatever_its_id(spark):
    base, other, third = long_text(1), long_text(2), long_text(3)
    near = lambda t: t.replace(t.split()[30], "changed", 1)
    rows = [(1, base), (1, other), (2, near(base)), (None, third), (None, near(third)), (None, near(other)), (None, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter(map(tuple, ngram_join.keep_one_per_class(docs.repartition(3)).collect()))
    assert sum(found[r] for r in ((None, third), (None, near(third)))) == 1
    assert found - Counter([(None, third), (None, near(third))]) == Counter([(1, base), (1, other), (None, ""), (4, None)])


def test_stages_match_brute_force(spark, tmp_path):
    import corpus_pipeline

    texts = [long_text(i) for i in range(40)]
    near = [" ".join("changed" if k == 30 else w for k, w in enumerate(t.split())) for t in texts[:5]]
    clean = [*texts, *texts[:10], *near, "", ""]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate([*clean, *[f"vile slur {t}" for t in texts[20:40]]])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= len(clean))) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        left.append(sorted(r[0] for r in docs.select("doc_id").collect()))
    assert left[0] == list(range(len(clean)))
    assert left[1] == [*range(40), *range(50, 56)]
    assert left[2] == [*range(40), 55]
    assert set(left[3]) <= set(left[2])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert Counter(r[0] for r in packed.filter("start = 0").select("doc_id").collect()) == Counter(left[3])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100


def test_mix_keeps_to_targets(spark, empty):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(1, 60))), ["a", "b", "c", None][i % 4]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs).collect()
    assert len(found) == 2000 and all(r["taken"] == r["copies"] * r["size"] and r["copies"] <= 3 for r in found)
    size, taken, target = Counter(), Counter(), {}
    for r in found:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    weights = {"a": 1, "b": 2, "c": 3, None: 1}
    want, capped = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        want = {s: 3 * size[s] if s in capped else left * weights[s] / sum(w for x, w in weights.items() if x not in capped) for s in size}
        over = {s for s in size if want[s] > 3 * size[s] + 1e-6}
        if not over:
            break
        capped |= over
    assert all(abs(target[s] - want[s]) < 1e-6 * want[s] and abs(taken[s] - want[s]) <= 0.002 * want[s] for s in size)
    assert Counter(map(tuple, mixing.mix_sources(docs.repartition(7)).collect())) == Counter(map(tuple, found))
    assert mixing.repeat_rows(docs).count() == sum(r["copies"] for r in found)
    assert mixing.mix_sources(empty).count() == 0


def test_archives_round_trip(spark):
    page = "<p>é" + "x" * 200
    pages = spark.createDataFrame([(3, "u", page), (1, None, page), (2, "a b\r\nc", None), (4, "u", "short"), (5, "u", "short"), (6, "v", page)], "page_id long, url string, html string")
    found = {r["page_id"]: r for r in warc.archive_round_trip(pages).collect()}
    assert len(found) == 6 and found[1]["record_type"] == "response" and found[3]["refers_to"] == found[6]["refers_to"] == 1
    assert found[5]["record_type"] == "response" and found[2]["payload_bytes"] == 0
    assert all(found[i]["payload_digest"] == hashlib.sha256(page.encode()).hexdigest() and found[i]["payload_bytes"] == len(page.encode()) for i in (1, 3, 6))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>menu</nav><article><h1>T &amp; x</h1><p>a <b>b</b>\n c<p>d</article><footer>f</footer>", "T & x\na b c\nd"),
        ("<article><p>story</p><div class='comments'><p>me first</p></div><form>q<input></form><aside>s</aside></article>", "story"),
        ("<body><div class=sidebar>x</div><p>only text here, really.</p><script>var a='</p>';</script></body>", "only text here, really."),
        ("<div class='cookie-notice'>We use cookies.</div><main><p>kept</p></main>", "kept"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


STORY = "A long sentence of the story, with commas, that goes on for a while; then it ends. And another one follows, as stories do."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class=story><h1>T</h1><div>{STORY}</div><div>{STORY}</div></div><article><p>A teaser, it leads elsewhere.</p></article>", f"T\n{STORY}\n{STORY}\nA teaser, it leads elsewhere."),
        (f"<div><h2>T</h2><p>{STORY}</p><p>Short end.</p></div><div class=links><a href=x>More of this</a></div>", f"T\n{STORY}\nShort end."),
        (f"<article><p>{STORY}</p><div class=x>Advertisement</div><p>{STORY}</p><ul><li><a href=x>More of this</a></li></ul></article>", f"{STORY}\n{STORY}"),
        (f"<main><p>{STORY}</p><ul><li><a href=x>Smith, J. (2001). On things. Journal, 3.</a></li></ul><ol><li>Two eggs</li></ol></main>", f"{STORY}\nSmith, J. (2001). On things. Journal, 3.\nTwo eggs"),
    ],
)
def test_ratios_decide_on_every_page(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        *[(f"<div class='{name}'><h1>T</h1><p>{STORY}</p><p>{STORY}</p></div><div class=footer>Made by us.</div>", f"T\n{STORY}\n{STORY}") for name in ("post hentry category-x tag-y", "has-sidebar", "no-sidebar", "layout-side", "notice", "legal", "sidebar-main")],
        *[(f"<article><div class='{name}'><h1>T</h1><p class=byline>By X</p></div><p>{STORY}</p><p>{STORY}</p></article>", f"T\n{STORY}\n{STORY}") for name in ("entry-header", "article-header")],
        (f"<article><p>{STORY}</p><p>{STORY}</p><section class=related-work><h2>Related work</h2><p>{STORY}</p></section></article>", f"{STORY}\n{STORY}\nRelated work\n{STORY}"),
        ("".join(f"<div class=col><div class='box widget-text'><p>{i} {STORY}</p></div></div>" for i in range(4)), "\n".join(f"{i} {STORY}" for i in range(4))),
        (f"<div class=body><p>{STORY}</p><p>See <a class=nav-link href=x>this</a>, too.</p></div><div class=comments><h2>Said</h2><p>Me first, and long. {STORY}</p></div>", f"{STORY}\nSee this, too."),
    ],
)
def test_names_are_a_penalty_only(page, text):
    assert html.main_text(page) == text


def test_packing_covers_every_id_once(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    want = Counter(len(tokenizer.encode(r[0] or "", add_special_tokens=False).ids) + 1 for r in docs.select("text").collect())
    assert Counter(r["doc_tokens"] for r in rows if r["start"] == 0) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for s, parts in by.items():
        ends = 0
        for at, n in sorted(parts):
            assert at == ends
            ends += n
        assert ends == 1024 or s == max(by)
    assert packing.pack(empty).count() == 0


def test_neighbours_match_brute_force(spark):
    x = np.random.default_rng(1).standard_normal((600, 16))
    x[300:420] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1050, x[5].tolist())]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    ids, mat = np.array([*range(600), 1050]), np.vstack([x, x[5]])
    unit = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    hit = total = 0
    for q in [i for i in ids if i % 50 == 0]:
        score = unit @ unit[list(ids).index(q)]
        best = [i for _, i in sorted((-round(s, 12), i) for s, i in zip(score, ids, strict=True) if i != q)[:5]]
        own = [r["vec_id"] for r in sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])]
        assert len(own) == 5
        hit, total = hit + len(set(own) & set(best)), total + 5
    assert hit / total >= 0.9
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_at_size_compare_few_rows(spark):
    report = {}
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = ann.nearest(df, F.col("vec_id") % 50 == 0, report=report).toPandas()
    rows = df.toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.array([np.asarray(v, float) for v in rows["embedding"]])
    unit, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    asked = ids[ids % 50 == 0]
    for q in asked:
        score = unit @ unit[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -2
        hit += len(set(ids[np.argsort(-score)[:5]]) & set(found[found["query_id"] == q]["vec_id"]))
    assert hit / (5 * len(asked)) >= 0.9 and report["recall"] >= 0.9 and report["compared"] < 0.3


def test_neighbours_of_extreme_vectors_and_small_tables(spark):
    rows = [(0, [1e-200, 2e-200]), (1, [1e-200, 2.1e-200]), (50, [1e200, 2e200]), (3, [1.0, -1.0]), (4, [5.0, 1.0]), (7, [1.0]), (100, None), (150, [float("inf"), 1.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    by = {q: [(r.vec_id, round(r.score, 9)) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert len(found) == 8 and [i for i, _ in by[0]] == [50, 1, 4, 3] and [i for i, _ in by[50]] == [0, 1, 4, 3]
    assert by[0][0][1] == 1.0 and by[0][3][1] == round(-1 / 10**0.5, 9)


def test_neighbours_when_ids_repeat(spark):
    rows = [(0, [1.0, 0.001 * i]) for i in range(8)] + [(i, [1.0, 0.01 * i]) for i in range(1, 8)] + [(1, [1.0, 0.01])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, leaf string, qid int")
    found = ann.nearest(docs, F.col("vec_id") == 0).toPandas()
    nearest = found[found["score"] <= 1].groupby(["query_id"]).size()
    assert nearest[0] == 8 * 5 and not (found["vec_id"] == 0).any()
    exact = found.sort_values("rank").groupby("rank")["vec_id"].agg(set)
    assert exact[1] == exact[2] == {1}


def test_classifiers_hold_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() >= 0.95
    model = toxicity.fit(docs, labels.filter(~quality.held_out()))
    scored = toxicity.score_toxicity(docs, model).withColumnRenamed("toxic", "found").join(labels.filter(quality.held_out()), "doc_id").toPandas()
    assert (scored["found"] == (scored["toxic"] == 1)).mean() >= 0.95 and not scored[(scored["toxic"] == 0)]["found"].any()


def test_classifiers_take_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 0), (2, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    for table in (docs, empty):
        assert quality.score_quality(table, labels).count() == table.count()
        assert toxicity.score_toxicity(table, toxicity.fit(table, labels)).count() == table.count()
