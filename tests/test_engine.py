"""Hand-derived expectations for the retrieval operators."""

from __future__ import annotations

import json
import math
import random
import re
import zipfile
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrane.functions import text as T
from terrane.operators import areas as A
from terrane.operators import batch
from terrane.operators import index as I
from terrane.operators import resolve as R
from terrane.operators import watch as W
from terrane.sources import documents as D
from terrane.sources.storage import stored

STEMS = {"policies": "policy", "running": "run", "falling": "fal", "stopped": "stop", "agreed": "agreed", "tires": "tire", "boxes": "boxe", "bus": "bus", "glass": "glass", "axis": "axis", "sing": "sing", "string": "str"}


def test_stems_agree_in_both_forms(spark):
    assert {w: T.py_stem(w) for w in STEMS} == STEMS
    rows = spark.createDataFrame([(w,) for w in STEMS], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == STEMS


def test_tokens(spark):
    cases = {"we're getting a cold snap this weekend, what should I do?": ["cold", "snap", "weekend"], "5W-30 0W-20 10 100": ["5w", "0w", "100"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.tokens(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases == {k: T.py_tokens(k) for k in cases}
    assert len(T.STOPWORDS) == 232


def test_slug_and_label(spark):
    rows = spark.createDataFrame([("My Notes!",), ("税金",), ("tax-rules",)], "t string").select(T.slug(F.col("t")).alias("s"), T.human(F.col("t")).alias("h")).collect()
    assert [r.s for r in rows] == ["my-notes", "domain", "tax-rules"] and rows[2].h == "Tax Rules"


def test_bm25_value(spark):
    chunks = spark.createDataFrame([(0, "a.md", "", "", "cold cold snap"), (1, "b.md", "", "", "warm")], "chunk_id long, doc string, title string, section string, text string")
    q = I.query_terms(spark.createDataFrame([("q", 0, "cold")], "query_id string, turn int, text string"))
    (hit,) = I.search(q, I.build_index(chunks)).collect()
    assert hit.chunk_id == 0 and hit.score == pytest.approx(0.847670, abs=1e-6)


def test_search_adds_up_where_the_weights_lie(spark, capsys):
    """Of each bucket only the best chunks are dealt; they are those of a search that deals every pair."""
    rows = [(i, "a", "", "", "cold snap " * (i % 7 + 1) + f"word{i} " * (i % 3)) for i in range(200)]
    index = I.build_index(spark.createDataFrame(rows, "chunk_id long, doc string, title string, section string, text string"))
    q = I.query_terms(spark.createDataFrame([("a", 0, "cold snap"), ("b", 0, "word4 snap")], "query_id string, turn int, text string"))
    want = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in I.search(q, index, 3).collect())
    index.weights = I.stored_weights(index.weights, 4 * I.BUCKET_ROWS)
    found = I.search(q, index, 3)
    assert sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in found.collect()) == want
    found.explain()
    plan = capsys.readouterr().out
    assert "Bucketed: true" in plan and "Exchange hashpartitioning(query_id" in plan and "Exchange hashpartitioning(query_id#, chunk_id" not in re.sub(r"#[0-9]+L?", "#", plan)


def test_word_counts_are_dealt_by_size(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, "", "", f"cold snaps w{i}") for i in range(40)], "chunk_id long, title string, section string, text string")
    monkeypatch.setattr(I, "TASK_CHARS", 50)
    found = I.term_frequencies(chunks)
    assert found.rdd.getNumPartitions() == 1 + sum(len(f"cold snaps w{i}") for i in range(40)) // 50
    assert {(r.term, r.f) for r in found.where("chunk_id = 11").collect()} == {("cold", 1), ("snap", 1), ("w11", 1)}


@pytest.fixture
def worded(spark):
    """An index of 60 documents of two chunks each, in three folders; its rows by chunk."""
    draw = random.Random(3)
    rows = [(i, f"s{i % 3}/{i // 2}.txt", f"s{i % 3}", "", "", " ".join(["common"] * (i % 4 + 1) + [f"word{draw.randrange(40)}" for _ in range(12)] + ["the", "123", "ab"])) for i in range(120)]
    rows = [(i, f"s{i // 2 % 3}/{i // 2}.txt", f"s{i // 2 % 3}", *r) for i, _, _, *r in rows]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc string, folder string, title string, section string, text string")
    return rows, chunks, I.build_index(chunks)


def test_vectors_in_tasks_of_so_many_postings(spark, worded, monkeypatch, capsys):
    """No task's rows grow with the corpus, frequent terms are not dealt by term, and products are added up where vectors lie."""
    rows, _, index = worded
    n = index.postings.count()
    monkeypatch.setattr(I, "TASK_ROWS", 200)
    monkeypatch.setattr(I, "OFTEN", 30)
    counts = defaultdict(lambda: defaultdict(int))
    for _, doc, *_, text in rows:
        for t in T.py_tokens(text):
            counts[doc][t] += 1
    df = defaultdict(int)
    for f in counts.values():
        for t in f:
            df[t] += 1
    assert any(x > n // 30 for x in df.values()) and any(x <= n // 30 for x in df.values())
    raw = {doc: {t: (1 + math.log(f)) * math.log((len(counts) + 1) / (df[t] + 0.5)) for t, f in fs.items()} for doc, fs in counts.items()}
    want = {(doc, t): x / math.sqrt(sum(y * y for y in v.values())) for doc, v in raw.items() for t, x in v.items()}
    vectors = A.document_vectors(index)
    assert {(r.doc, r.term): r.x for r in vectors.collect()} == pytest.approx(want)
    pivots = spark.createDataFrame([("s0/0.txt",), ("s1/1.txt",)], "doc string")
    cosines = A.document_cosines(vectors, pivots)
    capsys.readouterr()
    cosines.explain()
    plan = capsys.readouterr().out
    assert "Exchange hashpartitioning(a#" not in plan and f"SelectedBucketsCount: {n // 200 + 1} out of {n // 200 + 1}" in plan
    found = {(r.a, r.b): r.cosine for r in cosines.collect()}
    assert len(found) == 2 * (len(counts) - 1)
    for (a, b), x in found.items():
        assert x == pytest.approx(sum(want[a, t] * want.get((b, t), 0) for t in counts[a]))


def test_distinctive_terms_deal_counts_only(spark, worded, capsys):
    """Postings are read once, and words that do not qualify are not dealt, though they count among an area's tokens."""
    rows, chunks, index = worded
    f, df = defaultdict(int), defaultdict(int)
    for _, _, folder, *_, text in rows:
        for t in T.py_tokens(text):
            f[folder, t] += 1
        for t in set(T.py_tokens(text)):
            df[t] += 1
    total = {g: sum(n for (a, _), n in f.items() if a == g) for g in ("s0", "s1", "s2")}
    want = []
    for g in total:
        w = {t: n / total[g] * math.log(1 + (120 - df[t] + 0.5) / (df[t] + 0.5)) * (math.log(4 / sum((a, t) in f for a in total)) + 0.1) for (a, t), n in f.items() if a == g and len(t) > 2 and not t.isdigit()}
        want += [(g, nth, t) for nth, t in enumerate(sorted(w, key=lambda t: (-round(w[t], 12), t))[: A.ALIASES], 1)]
    index.postings = I.stored_postings(chunks)
    found = A.distinctive_terms(index, A.folder_areas(chunks))
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert sorted((r.area_id, r.nth, r.term) for r in found.collect()) == sorted(want)
    assert len(re.findall(r"FileScan .*terrane_postings", plan)) == 1 and not re.search(r"FileScan .*terrane_postings.*Bucketed: false", plan)


def test_surface_forms_of_some_stems(spark, worded):
    _, chunks, _ = worded
    odd = spark.createDataFrame([(0, "", "", "runs runs running ran storms storm"), (1, "", "", "storm running")], "chunk_id long, title string, section string, text string")
    assert {tuple(r) for r in I.surface_forms(odd, spark.createDataFrame([("run",), ("run",), ("none",)], "term string")).collect()} == {("run", "running")}
    assert I.surface_forms(chunks, I.surface_forms(chunks)).exceptAll(I.surface_forms(chunks)).count() == 0


def test_blocks_of_queries_and_chunks_against_a_plain_walk(monkeypatch):
    """Frequent and rare terms, many small blocks, ties of equal chunks, and bests that are sifted on the way."""
    for name, value in {"BLOCK_CHUNKS": 16, "BLOCK_QUERIES": 3, "PIECE": 50, "HELD": 60, "DENSE": 0.2, "BARRED": 2}.items():
        monkeypatch.setattr(batch, name, value)
    rng, k, avgdl = np.random.default_rng(2), 3, 9.0
    kinds = [{int(t): int(rng.integers(1, 4)) for t in rng.zipf(1.4, 12) if t < 40} for _ in range(30)]
    chunks = [(i, [None, "a", "b", "c"][i % 4], kinds[int(rng.integers(30))]) for i in rng.permutation(90).tolist()]
    rows = pa.RecordBatch.from_pylist([{"chunk_id": c, "dl": sum(f.values()), "id": a, "terms": [f"t{t}" for t in f], "fs": list(f.values())} for c, a, f in chunks], pa.schema([("chunk_id", pa.int64()), ("dl", pa.int64()), ("id", pa.string()), ("terms", pa.list_(pa.string())), ("fs", pa.list_(pa.int32()))]))
    asked = [{int(t): float(rng.random()) for t in rng.integers(1, 40, 8)} | {1: 0.5} for _ in range(7)]
    for areas in ([None] * 7, ["a", "a", "a", "a", "b", "b", "zz"]):
        q, t, w = (np.array(x) for x in zip(*((i, t - 1, w) for i, words in enumerate(asked) for t, w in words.items()), strict=True))
        blocks = list(batch.blocks_of(q, t, w, areas))
        (found,) = batch.scored([rows.slice(0, 40), rows.slice(40)], blocks, pa.array([f"t{t}" for t in range(1, 40)]), 7, avgdl, k)
        got = {(int(a), b, int(c)): round(float(d), 9) for a, b, c, d in zip(*found, strict=True)}
        want = {}
        for i, words in enumerate(asked):
            for area in {a for _, a, _ in chunks} if areas[i] is None else {areas[i]}:
                add = lambda f: sum(words[t] * f[t] * 2.4 / (f[t] + 1.4 * (0.25 + 0.75 * sum(f.values()) / avgdl)) for t in f if t in words)  # noqa: B023, E731
                scores = sorted((-round(add(f), 9), c) for c, a, f in chunks if a == area and add(f) > 0)
                want |= {(i, area, c): -s for s, c in scores[:k]}
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 2e-9 for x in want)


def test_searches_over_rows_of_chunks(spark, worded, monkeypatch, capsys):
    """The same hits as over weights, in several passes too, and no pair of query and chunk is dealt before it is among the best."""
    rows, chunks, index = worded
    members = spark.createDataFrame([(f"a{i % 3}", i) for i, *_ in rows if i % 5], "id string, chunk_id long")
    index = I.build_index(chunks, members)
    other = I.Index(index.chunks, index.postings, index.lengths, index.terms, index.corpus, None, batch.packed_postings(index.postings, members))
    words = [r["term"] for r in index.terms.orderBy("term").limit(40).collect()]
    q = spark.createDataFrame([(i, words[(7 * i + j * j) % len(words)], 1.0 + j / 10) for i in range(9) for j in range(6)], "query_id long, term string, weight double").groupBy("query_id", "term").agg(F.sum("weight").alias("weight"))
    seen = lambda df, *c: sorted((*(str(r[x]) for x in c), round(r["score"], 8)) for r in df.collect())
    within = q.withColumn("domain_id", F.concat(F.lit("a"), F.pmod("query_id", F.lit(4))))
    for most in (batch.PASS_WORDS, 10):
        monkeypatch.setattr(batch, "PASS_WORDS", most)
        found = I.best_chunks(q, other, 3)
        assert seen(found, "query_id", "id", "chunk_id") == seen(I.best_chunks(q, index, 3), "query_id", "id", "chunk_id")
        a, b = (I.best_within(within, i, ("query_id", "domain_id"), 2) for i in (other, index))
        assert seen(a, "query_id", "domain_id", "chunk_id", "rank") == seen(b, "query_id", "domain_id", "chunk_id", "rank") != []
    monkeypatch.undo()
    assert not I.best_chunks(q.limit(0), other, 3).collect() and not I.best_within(within.withColumn("domain_id", F.lit(None).cast("string")), other, ("query_id", "domain_id"), 2).collect()
    nameless = q.where("query_id = 1").withColumn("query_id", F.lit(None).cast("long"))
    assert seen(I.best_chunks(nameless, other, 3), "query_id", "id", "chunk_id") == seen(I.best_chunks(nameless, index, 3), "query_id", "id", "chunk_id") != []
    other.packed = stored(other.packed, "packed")
    capsys.readouterr()
    I.best_chunks(q, other, 3).explain()
    assert capsys.readouterr().out.count("Exchange") == 1


def test_query_weights_and_window(spark):
    turns = [("a", 0, "dog"), ("a", 1, "dog cat"), ("b", 0, "")] + [("c", i, f"word{i}") for i in range(9)]
    rows = I.query_terms(spark.createDataFrame(turns, "query_id string, turn int, text string")).collect()
    got = {(r.query_id, r.term): round(r.weight, 6) for r in rows}
    assert got[("a", "dog")] == 1.4 and got[("a", "cat")] == 1.0
    assert {t for q, t in got if q == "c"} == {f"word{i}" for i in range(3, 9)}


def test_signals(spark):
    areas = spark.createDataFrame([("x", ["leaving town for the holidays", "cold snap", "pipes", "road trip"])], "id string, signals array<string>")
    said = {"leaving town": 0.4, "cold snap": 1.0, "pipes": 0.75, "road": None}
    turns = spark.createDataFrame([(k, 0, k) for k in said], "query_id string, turn int, text string")
    rows = R.signal_scores(R.signal_hits(I.query_terms(turns), R.signal_phrases(areas))).collect()
    assert {r.query_id: round(r.sig, 6) for r in rows} == {k: v for k, v in said.items() if v}


def test_chunks():
    assert [len(c) for _, c in D.chunk_text("a " * 1000)] == [1599, 399]
    assert [len(c) for _, c in D.chunk_text("x" * 3500)] == [1600, 1600, 300]
    assert D.chunk_text("# A\n\np1\n\n## B\np2") == [("A", "p1"), ("B", "p2")]
    assert D.chunk_text("") == []


def test_html_and_titles(spark):
    page = "<h2>Top <b>x</b></h2><script>bad()</script><p>a &amp; b</p><div>c</div>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, "<H1>é &lt;i&gt;</H1>\n\n\n<p>x<br>y</p>")], "id int, html string")
    got = {r.id: r.text for r in D.html_to_text(pages).collect()}
    assert got[1] == "## Top x\n\n a & b\n\n c".replace("\n\n ", "\n\n")
    assert got[2] == "" and got[3] == "# é <i>\n\nx\n\ny"
    named = spark.createDataFrame([("text\n# Head #", "x.md"), ("", "my_note-1.md"), ("\n" * 40 + "# late", "a/b.txt"), ("#no", "x/_.md")], "text string, path string")
    assert [r.t for r in named.select(D.guess_title(F.col("text"), F.col("path")).alias("t")).collect()] == ["Head", "my note 1", "b", "_.md"]


def test_documents_need_more_than_headings(spark):
    texts = {"a.md": "# Only\n\n## Headings\n", "b.md": "# With\nbody", "c.md": " \n", "d/e.html": "<h1>x</h1>", "d/f.html": "<h1>x</h1>y"}
    files = spark.createDataFrame([(i, k, 0.0, 0, v) for i, (k, v) in enumerate(texts.items())], D.RAW)
    rows = {r.doc: (r.title, r.folder) for r in D.parse_documents(files).collect()}
    assert rows == {"b.md": ("With", None), "d/f.html": ("x", "d")}
    assert {k for k in texts if k.endswith("md") and D.chunk_text(texts[k])} == {"b.md"}


def test_walk_order(spark, tmp_path):
    names = ["b.txt", "a/z.md", "a/sub/y.md", "a.b/x.md", "a/.hidden.md", "node_modules/n.md", "a/venv/m.md", "_w.md", "a/no.exe"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x")
    rows = D.scan_files(spark, str(tmp_path)).orderBy("doc_ord").collect()
    assert [(r.doc_ord, r.path) for r in rows] == list(enumerate(["_w.md", "b.txt", "a/z.md", "a/sub/y.md", "a.b/x.md"]))


def test_damaged_docx():
    import io

    def packed(xml: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml", xml)
        return out.getvalue()

    assert D.docx_text(packed('<d xmlns:w="w"><w:p>a<w:tab/>b</w:p><w:p>c</w:p><w:p>lost')) == "a\tb\n\nc\n\nlost"
    assert D.docx_text(b"no zip") == ""


def test_load_folder(spark, tmp_path):
    (tmp_path / "car").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "car" / "tires.md").write_text("# Tires\n\nRotate them.")
    (tmp_path / "_note.txt").write_text("loose")
    (tmp_path / "blank.md").write_text("  ")
    (tmp_path / "x.exe").write_text("no")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p>one</w:p><w:p>t&amp;o</w:p>")
    rows = {r.doc: r for r in D.load_documents(spark, str(tmp_path)).collect()}
    assert set(rows) == {"_note.txt", "car/tires.md", "d.docx"}
    assert rows["car/tires.md"].folder == "car" and rows["car/tires.md"].title == "Tires" and rows["d.docx"].text == "one\n\nt&o"


def test_entities_without_their_semicolon(spark):
    pages = spark.createDataFrame([(0, "<h1>a &amp</h1><p>&copy;&lt;b&#33; &nosuch; x&ampy; &amp;lt;</p>")], "page_id long, html string")
    assert D.html_to_text(pages).first()["text"] == "# a &\n\n\u00a9<b! &nosuch; x&y; &lt;"
    assert D.html_to_text(pages, closed=True).first()["text"] == "# a &amp\n\n\u00a9<b! &nosuch; x&ampy; &lt;"
    assert D.parse_documents(spark.createDataFrame([(0, "p.html", 0.0, 0, "<h1>a &amp</h1><p>b</p>")], D.RAW), closed=True).first()["title"] == "a &amp"


def test_greedy_clusters():
    vectors = [("a", [("x", 1.0)]), ("b", [("x", 0.8), ("y", 0.6)]), ("c", [("z", 1.0)]), ("d", []), ("e", [])]
    assert dict(A.greedy_clusters(vectors)) == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 3}


def test_centroid_lists_move_and_keep_their_sums():
    """Lists that fill up are summed up by cluster; the clusters are those of a plain walk over dense means."""
    rng = np.random.default_rng(4)
    found, centroids = A.Centroids(), []
    for _ in range(600):
        terms = np.sort(rng.choice(60, 12, replace=False))
        x = rng.random(12)
        x /= np.linalg.norm(x)
        dense = np.zeros(60)
        dense[terms] = x
        sims = [dense @ c for c, _ in centroids]
        want = int(np.argmax(sims)) if sims and max(sims) >= A.SIMILAR else len(centroids)
        c, k = centroids[want] if want < len(centroids) else (np.zeros(60), 0)
        mean = c * k + dense
        centroids[want : want + 1] = [(mean / np.linalg.norm(mean), k + 1)]
        assert found.place(terms.astype(np.int64), x) == want
    assert found.end < 60 * 64 and found.used.sum() <= 4 * 60 * len(centroids)


def test_frequent_terms_have_no_lists():
    """The clusters stay as they are, and documents meet frequent terms only in clusters that may be similar enough."""
    rng = np.random.default_rng(6)
    plain, bounded, met = A.Centroids(), A.Centroids(40), []
    over = bounded._over_frequent
    bounded._over_frequent = lambda some, *a: met.append(len(some)) or over(some, *a)
    for _ in range(1500):
        terms = np.unique(np.concatenate([rng.choice(40, 10, replace=False), 40 + rng.choice(4000, 30, replace=False)])).astype(np.int64)
        x = np.where(terms < 40, 0.3, 1) * rng.random(len(terms))
        x /= np.linalg.norm(x)
        assert bounded.place(terms, x) == plain.place(terms, x)
    assert not bounded.used[:40].any() and bounded.larger and sum(met) < 0.5 * 1500 * plain.clusters / 2


def test_clusters_against_running_means(spark):
    rng = np.random.default_rng(3)
    rows, centroids, want = [], [], {}
    for i in range(120):
        x = rng.normal(size=40) * (rng.random(40) < 0.12)
        doc = f"d{i:03}"
        rows += [(doc, f"t{k}", float(v)) for k, v in enumerate(x / (np.linalg.norm(x) or 1.0)) if v]
        x = x / (np.linalg.norm(x) or 1.0)
        sims = [x @ c for c, _ in centroids]
        best = int(np.argmax(sims)) if sims else -1
        if best < 0 or sims[best] < A.SIMILAR:
            centroids.append((x, 1))
            want[doc] = len(centroids) - 1
        else:
            c, k = centroids[best]
            mean = c * k / (k + 1) + x / (k + 1)
            centroids[best] = (mean / np.linalg.norm(mean), k + 1)
            want[doc] = best
    docs = spark.createDataFrame([(d,) for d in want], "doc string")
    got = A.cluster_documents(spark.createDataFrame(rows, "doc string, term string, x double"), docs)
    assert {r.doc: r.cluster for r in got.collect()} == want


def test_ids_go_around_taken_ones(spark):
    names = ["a-b", "a-b-2", "a-b", "a-b", "x", "x-2", "y-2", "y-2"]
    rows = A.unique_ids(spark.createDataFrame(list(enumerate(names)), "ord int, id string")).orderBy("ord").collect()
    assert [r.id for r in rows] == ["a-b", "a-b-2", "a-b-3", "a-b-4", "x", "x-2", "y-2", "y-2-2"]


def fold(rows: list[dict], k: int, budget: int) -> list[tuple]:
    """The passages of one query, straight from the rules."""
    taken: dict[int, str] = {}
    used = 0

    def add(r) -> bool:
        nonlocal used
        if r["chunk_id"] in taken or len(taken) >= k or r["parked"] or taken and used + r["chars"] > budget:
            return False
        taken[r["chunk_id"]] = r["via"]
        used += r["chars"]
        return True

    for stage in sorted({r["stage"] for r in rows}):
        own = sorted((r for r in rows if r["stage"] == stage), key=lambda r: r["rank"])
        if own[0]["kind"] == 0:
            for r in own:
                add(r)
            continue
        quota = max(1, math.ceil(round((k - len(taken)) * own[0]["area"] / own[0]["total"], 9)))
        got = 0
        for r in own[: quota + R.SPARE if own[0]["kind"] == 1 else min(2, quota)]:
            got += add(r)
            if got == quota:
                break
    return [(i + 1, c, v) for i, (c, v) in enumerate(taken.items())]


def test_passages_against_the_rules(spark):
    rng, rows = random.Random(5), []
    for q in range(150):
        scores = [round(rng.uniform(0.4, 1), 6) for _ in range(rng.randint(0, 4))]
        chunk = lambda: rng.randint(1, 25)
        own = []
        for stage, n, kind in [(0, 2, 0), *((i + 1, rng.randint(1, 12), rng.choice((1, 1, 2))) for i in range(len(scores))), (R.LAST, rng.randint(0, 8), 0)]:
            area = scores[stage - 1] if kind else 0.0
            for rank, c in enumerate(dict.fromkeys(chunk() for _ in range(min(n, 2) if kind == 2 else n)), 1):
                own.append({"query_id": q, "stage": stage, "kind": kind, "rank": rank, "chunk_id": c, "domain_id": f"d{c % 5}", "via": rng.choice(("question", "area")), "area": area, "total": sum(scores) if kind else 0.0, "chars": 10 + c * 53 % 1200, "parked": c % 7 == 0})
        rows += own
    schema = "query_id int, stage int, kind int, rank int, chunk_id long, domain_id string, via string, area double, total double, chars int, parked boolean"
    got = defaultdict(list)
    for r in R.assembled(spark.createDataFrame([tuple(r.values()) for r in rows], schema), 8, 4000).orderBy("query_id", "n").collect():
        got[r.query_id].append((r.n, r.chunk_id, r.via))
    for q in range(150):
        assert got[q] == fold([r for r in rows if r["query_id"] == q], 8, 4000)


def test_quotations(spark, monkeypatch):
    said = {1: "xa b c d e f", 2: "b c d e f  g", 3: "b c d e f g", 4: "b c", 5: "b c", 6: "f", 7: "", 8: " ", 9: "zz", 10: "a b c d e", 11: None}
    texts = {1: "0 xa b c d e fg h", 2: "a b c d e f  g h", 3: "b c", 4: None, 5: "", 6: "f"}
    items = spark.createDataFrame(list(said.items()), "query_id int, item string")
    chunks = spark.createDataFrame([(i, f"d{i}", t) for i, t in texts.items()], "chunk_id int, doc string, text string")
    want = sorted((q, c, f"d{c}") for q, item in said.items() for c, text in texts.items() if item and text and item in text)
    assert sorted(map(tuple, W.quotations(items, chunks).collect())) == want
    monkeypatch.setattr(W, "BLOCK_CHARS", 3)  # many automata
    assert sorted(map(tuple, W.quotations(items, chunks).collect())) == want
    assert W.quotations(items.where("query_id = 1"), chunks).count() == 1 and W.quotations(items, chunks.limit(0)).count() == 0


def test_search_within_sets(spark):
    texts = ["cold snap", "cold", "cold cold snap", "snap", "warm"]
    ids = [0, 5, 32_768, 70_001, 1 << 40]
    chunks = spark.createDataFrame([(i, f"{i}", "", "", t) for i, t in zip(ids, texts, strict=True)], "chunk_id long, doc string, title string, section string, text string")
    sets = {"a": [5, 32_768], "b": [70_001, 1 << 40, 999], "empty": []}
    rows = spark.createDataFrame([(k, i) for k, v in sets.items() for i in v or [None]], "set_id string, chunk_id long")
    asked = [("all", None), ("in a", "a"), ("in b", "b"), ("in empty", "empty"), ("in unknown", "other")]
    queries = spark.createDataFrame([(q, t, 1.0, s) for q, s in asked for t in ("cold", "snap")], "query_id string, term string, weight double, set_id string")
    index = I.build_index(chunks)
    whole = {r.chunk_id: r.score for r in I.search(queries.where("query_id = 'all'"), index).collect()}
    assert set(whole) == {0, 5, 32_768, 70_001}
    got = {(r.query_id, r.chunk_id): r.score for r in I.search(queries, index, sets=rows).collect()}
    assert got == {(q, c): v for q, s in asked for c, v in whole.items() if s is None or c in sets.get(s, [])}


def test_best_chunks_are_those_of_all_scores(spark):
    rng = random.Random(8)
    chunks = spark.createDataFrame([(i, f"{i}", "", "", " ".join(rng.choice(["cold", "snap", "tire", "roof"]) for _ in range(rng.randint(1, 9)))) for i in range(200)], "chunk_id long, doc string, title string, section string, text string")
    members = spark.createDataFrame([(f"a{i % 3}", i) for i in range(200) if i % 4], "id string, chunk_id long")
    index = I.build_index(chunks, members)
    queries = spark.createDataFrame([(q, t, w) for q in "xyz" for t, w in (("cold", 1.0), ("snap", 0.4), ("roof", 1.4))], "query_id string, term string, weight double")
    scores = I.score_chunks(queries, index)
    best = I.best_chunks(queries, index, 5)
    assert best.count() == 3 * 4 * 5 < scores.count()
    key = lambda df: sorted((r.query_id, r.chunk_id, r.rank, round(r.score, 9)) for r in df.collect())
    assert key(I.ranked(best, k=5)) == key(I.ranked(scores, k=5))
    rel = lambda df: sorted((r.query_id, r.id, round(r.rel, 9)) for r in R.relevance(df).collect())
    assert rel(best) == rel(scores)


def test_membership_counts(spark):
    rows = spark.createDataFrame([("x", f"d{i}", i * 10 + j) for i in range(8) for j in range(2)] + [("y", "e", 99)], "area_id string, doc string, chunk_id int")
    got = {r.area_id: (r.documents, r.chunk_count, r.first_docs) for r in A.membership_counts(rows).collect()}
    assert got == {"x": (8, 16, [f"d{i}" for i in range(6)]), "y": (1, 1, ["e"])}


def test_watch_states(spark):
    sha = __import__("hashlib").sha256(b"new").hexdigest()
    state = spark.createDataFrame([("same", sha, sha, "new"), ("seen", sha, None, "new"), ("other", "0", None, "old")], "id string, sha256 string, accepted_sha string, latest_text string")
    fetched = spark.createDataFrame([(x, "new", None) for x in ("same", "seen", "other", "first")] + [("bad", None, "timeout")], "id string, text string, error string")
    assert {r.id: r.status for r in W.watch_status(state, fetched).collect()} == {"same": "unchanged", "seen": "awaiting review", "other": "changed", "first": "new", "bad": "error"}
    assert W.changed_lines("a\nb", "a\nc") == (["c"], ["b"])


def test_json_columns(spark):
    replies = ['```json\n{"a": 1}\n```', '[{"a": 1}]', "x [1, 2] y", "none", '{"a": 1} and {"b": 2}', '{"a": "}"} ok', '{bad} [3]']
    rows = spark.createDataFrame([(r,) for r in replies], "r string").select("r", F.to_json(W.json_part(F.col("r"))).alias("j")).collect()

    def value(reply):
        try:
            return W.extract_json(reply)
        except ValueError:
            return None

    assert {r.r: r.j and json.loads(r.j) for r in rows} == {r: value(r) for r in replies}
    assert value(replies[4]) is None and value(replies[6]) == [3] and value(replies[1]) == {"a": 1}


def test_json_replies():
    assert W.extract_json('```json\n{"a": 1}\n```') == {"a": 1} and W.extract_json('[{"a": 1}]') == {"a": 1} and W.extract_json("x [1, 2] y") == [1, 2]
    with pytest.raises(ValueError):
        W.extract_json("none")


def test_entry_module_lists_queries():
    import __spark_entry__ as e

    assert {"pack", "eval_recall", "bm25_search"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
