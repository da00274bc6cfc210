from __future__ import annotations

import datetime
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from actmill import schemas
from actmill.functions import html, stemmer, text
from actmill.jobs import answer_batch, build_corpus
from actmill.operators import chunking, ingest, lexical, models, postings, quality, sync
from actmill.operators.snapshot import Snapshot
from actmill.sources import tables

HISTORY = """<div id="istoric_fa"><a id="fa_selectata" title="Consolidarea din 05.03.2024">x</a>
<a title='Consolidarea din 05.03.2024' href='/Public/DetaliiDocument/70'>y</a>
<a title="Consolidarea din 01.02.2019" href="/Public/DetaliiDocumentAfis/71">z</a><a title="other">w</a></div>"""


def art(number: str, body: str, title: str = "") -> str:
    name = f'<span class="S_ART_DEN">{title}</span>' if title else ""
    return f'<span class="S_ART"><span class="S_ART_TTL">Articolul {number}</span>{name}<span class="S_ART_BDY">{body}</span></span>'


PAGE = (
    '<span class="S_TTL"><span class="S_TTL_TTL">Partea a VII-a</span><span class="S_TTL_DEN">Pescuit şi vânat</span><span class="S_TTL_BDY">'
    '<span class="S_CAP"><span class="S_CAP_TTL">Grupa 9</span><span class="S_CAP_BDY">'
    + art("1", '<span class="S_ALN"><span class="S_ALN_TTL">(1)</span><span class="S_ALN_BDY">Prima regulă, vezi <span class="S_LGI">art. 9</span> şi <span class="S_LGI">art. 2</span>.</span><span class="S_ALN_SHORT">(1) scurt</span></span><!-- c -->'
          '<span class="S_PAR">(la data de 01-02-2020 a fost modificat)</span><span class="S_NTA">notă</span><span class="S_ALN"><span class="S_ALN_TTL">(2)</span><span class="S_ALN_BDY">A doua:<span class="S_LIT"><span class="S_LIT_TTL">a)</span>unu;</span><span class="S_LIT"><span class="S_LIT_TTL">b)</span>abrogată.</span></span></span>')
    + art("2^1", '<span class="S_ALN">Abrogat.</span>')
    + art("3", '<span class="S_PAR">Statul nostru</span><span class="S_PAR">Este unul.</span>')
    + '<span class="S_ART"><span class="S_ART_BDY">fără titlu</span></span></span></span></span></span><span class="S_PAR">în afară</span>'
)


def parsed(spark):
    pages = spark.createDataFrame([(1, PAGE)], "page_id long, html string")
    meta = spark.createDataFrame([(1, "act", "Actul", "Legea 1/2000", "u", datetime.date(2024, 3, 5))], "page_id long, slug string, name string, short_ref string, url string, consolidation_date date")
    return ingest.clean_articles(html.raw_articles(pages), meta)


def test_versions(spark):
    pages = spark.createDataFrame([(1, HISTORY, 99), (2, "<p>none</p>", 98)], "page_id long, html string, current_doc_id long")
    found = ingest.consolidations(html.version_links(pages), pages)
    assert sorted((r.doc_id, str(r.version_date)) for r in found.collect()) == [(70, "2024-03-05"), (71, "2019-02-01"), (99, "2024-03-05")]
    latest = ingest.latest_version(found, "page_id")
    laws = spark.createDataFrame([(1, 5), (2, 6)], "page_id long, seed_id long")
    assert {r.page_id: (r.doc_id, str(r.version_date)) for r in ingest.with_seed(laws, latest, "page_id").collect()} == {1: (99, "2024-03-05"), 2: (6, "None")}


def test_parse(spark):
    good, bad = parsed(spark)
    a = {r.number: r for r in good.collect()}
    assert list(a) and set(a) == {"1", "2^1", "3"} and [r.problem for r in bad.collect()] == ["no heading"]
    assert a["1"].hierarchy == ["Partea a VII-a - Pescuit și vânat", "Grupa 9"]
    assert a["1"].units == ["(1) Prima regulă, vezi art. 9 și art. 2.", "(2) A doua:\na) unu;"]
    assert a["1"].references == ["art. 2", "art. 9"] and not a["1"].abrogated
    assert a["2^1"].abrogated and a["3"].title == "Statul nostru" and a["3"].units == ["Este unul."]
    assert ingest.reject_empty(spark.createDataFrame([(1, 'x class="S_ART" class="S_ART" class="S_ART_TTL"'), (2, "")], "page_id long, html string"))[0].first().n_articles == 2
    pages = spark.createDataFrame([(1, 4)], "page_id long, n_articles int")
    assert [r.problem for r in quality.check_parse(good, pages).collect()] == ["count differs"]


def test_markup_nested_deeply(spark):
    deep = 10_000
    page = '<div class="S_TTL"><span class="S_TTL_TTL">Unu</span>' + art("1", '<span class="S_PAR">' + "<b>" * deep + "jos" + "</b>" * deep + "</span>") + "</div>"
    rows = html.raw_articles(spark.createDataFrame([(1, page)], "page_id long, html string")).collect()
    assert [(r.units, r.hierarchy, r.problem) for r in rows] == [(["jos"], ["Unu"], None)]


def test_pages_that_cannot_be_read_go_to_quarantine(spark, monkeypatch):
    plain = html.article_rows

    def failing(text):
        if "broken" in text:
            raise ValueError("no end")
        return plain(text)

    monkeypatch.setattr(html, "article_rows", failing)
    assert html.page_rows("broken")[0]["problem"] == "not read: ValueError: no end"
    assert html.page_rows(art("1", "x")) == plain(art("1", "x"))
    monkeypatch.setattr(html, "article_rows", lambda text: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        html.page_rows("x")


def test_diacritics_as_unicode_has_them(spark):
    chosen = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x20000, 3), *range(0x2F800, 0x2FA20), *range(0xE0100, 0x110000, 9999))]
    rng = random.Random(2)
    texts = ["".join(chosen[i : i + 50]) for i in range(0, len(chosen), 50)] + ["".join(rng.choices(chosen, k=40)) for _ in range(500)] + ["", None, "ascii", "ﬁ½한글각…ș"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", text.strip_diacritics("t").alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for i, t in enumerate(texts)}


def test_tokenize_stays_in_the_engine(spark):
    plan = spark.range(1).select(text.tokenize(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_groups_and_chunks(spark):
    df = spark.createDataFrame([(["a" * 10, "b" * 10, "c" * 10],), (["x" * 40, "y"],), ([],)], "units array<string>")
    got = [[len(g) for g in r.g] for r in df.select(chunking.group_units(F.col("units"), F.lit(15)).alias("g")).collect()]
    assert got == [[1, 1, 1], [1, 1], []]
    unit = "(1) intro:\n" + "\n".join(f"{c}) " + c * 12 for c in "abcd")
    pieces = spark.createDataFrame([(unit,), ("one long line " * 9,)], "u string").select(chunking.split_long_unit(F.col("u"), 45).alias("p")).collect()
    assert len(pieces[0].p) > 1 and all(p.startswith("(1) intro:\n") for p in pieces[0].p)
    assert [x for p in pieces[0].p for x in p.split("\n")[1:]] == unit.split("\n")[1:]
    assert len(pieces[1].p) == 1
    rows = [("law", "Actul", "L 1", "7", "Titlu", ["Cap I"], ["unu doi trei patru cinci", "sase sapte opt noua zece"], "u", None, False, []), ("law", "Actul", "L 1", "8", "", [], [], "u", None, True, [])]
    a = spark.createDataFrame(rows, schemas.ARTICLE)
    one, two = chunking.chunk_articles(a).collect(), chunking.chunk_articles(a, 30).orderBy("part").collect()
    assert [(r.id, r.part, r.n_parts) for r in one] == [("law:art7:1", 1, 1)] and one[0].header == "Actul (L 1) > Cap I\nArt. 7 - Titlu"
    assert [(r.part, r.n_parts) for r in two] == [(1, 2), (2, 2)]
    assert quality.check_chunks(chunking.chunk_articles(a, 30)).count() == 0


def test_text(spark):
    df = spark.createDataFrame([("Concediul de ODIHNĂ, art. 152^2 și ţară",), ("de la",), (None,)], "t string")
    got = [r.k for r in df.select(text.tokenize(F.col("t")).alias("k")).collect()]
    assert got[0] == ["concediul", "odihna", "art", "152^2", "tara"] and got[1] == [] and got[2] is None
    vocabulary = text.stem_vocabulary(spark.createDataFrame([(["concediului", "concedii", "casa"],)], "k array<string>"), "k")
    stems = {r.term: r.stem for r in vocabulary.collect()}
    assert stems["concediului"] == stems["concedii"] != stems["casa"]
    assert {stemmer.stem(w) for w in ("lege", "legi", "legii", "legile", "legilor")} == {"leg"}
    assert stemmer.stem("nationalitate") == stemmer.stem("nationalitatii") and stemmer.stem("ai") == "ai" and stemmer.stem("") == ""
    caret = df.sparkSession.createDataFrame([("are are^1 a^2 la.care x^are x^y^z aceasta",)], "t string").select(text.tokenize(F.col("t"))).first()[0]
    assert caret == ["are^1", "a^2", "x^are", "x^y", "z"]
    ws = df.sparkSession.createDataFrame([(" a \t b \n\n c d ",)], "t string").select(text.collapse_ws(F.col("t"))).first()[0]
    assert ws == "a b\nc d"


# Words by the stem that the published rules give them.
STEMS = {
    "abrupt": "abruptă", "absent": "absent absentă absente", "absenţ": "absenţa absenţă absenţi", "absol": "absolut absoluta absolută absolute absolutul absolutului",
    "absolv": "absolve absolvi absolvire absolvit absolviţi", "absorb": "absorbant absorbantă absorbi absorbit absorbite absorbiţi", "absorbţ": "absorbţia", "abstinent": "abstinent",
    "abstract": "abstract abstractă abstracte", "abstractiz": "abstractiza abstractizare abstractizat abstractizăm", "abstracto": "abstracto", "abstracţ": "abstracţia abstracţii abstracţiilor",
}


@pytest.mark.parametrize("stem", STEMS)
def test_stems_by_the_published_rules(stem):
    assert {w: stemmer.stem(w) for w in STEMS[stem].split()} == dict.fromkeys(STEMS[stem].split(), stem)


def test_sync_and_vectors(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "id string, hash string")
    assert {r.id: r.state for r in sync.diff_index(old, new).collect()} == {"a": "same", "b": "changed", "c": "stale", "d": "new"}
    after = sync.apply_sync(old.withColumn("by", F.lit("old")), new, lambda d: d.withColumn("by", F.lit("new")))
    assert {(r.id, r.hash, r.by) for r in after.collect()} == {("a", "1", "old"), ("b", "9", "new"), ("d", "4", "new")}
    v = spark.createDataFrame([("x y",), ("",)], "t string").select(sync.embed_column(models.hashing_encoder(8), F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-6 and not any(v[1].v)


def test_snapshot_keeps_the_files_of_unchanged_buckets(spark, tmp_path):
    at, schema = str(tmp_path / "table"), "id string, hash string, by string"
    rows = lambda changes: spark.createDataFrame([(f"k{i}", changes.get(i, str(i))) for i in range(200) if changes.get(i, "") is not None], "id string, hash string")
    embed = lambda who: lambda todo: todo.withColumn("by", F.lit(who))
    table = Snapshot(spark, at, schema, 16)
    assert table.read().count() == 0
    assert table.sync(rows({}), embed("one")) == {"new": 200, "changed": 0, "same": 0, "stale": 0}
    files = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "table").rglob("*.parquet")}
    first, before = files(), {r.id: r.by for r in table.read().collect()}
    assert table.sync(rows({7: "new", 8: None}), embed("two")) == {"new": 0, "changed": 1, "same": 198, "stale": 1}
    version, of = table.manifest()
    assert version == 2 and sum(v == 2 for v in of.values()) <= 2 and len(of) == 16
    assert {f: t for f, t in files().items() if "/v=1/" in f} == first
    used = {f.rsplit("file:", 1)[-1].rsplit("/", 1)[0] for f in table.read().inputFiles()}
    assert {u.split("/table/")[1] for u in used} == {f"v={v}/bucket={k}" for k, v in of.items()}
    assert {r.id: r.by for r in table.read().collect()} == {k: "two" if k == "k7" else by for k, by in before.items() if k != "k8"}
    assert table.sync(rows({7: "new", 8: None}), embed("three"))["same"] == 199 and table.manifest()[0] == 2
    # A sync that fails before its last step leaves the version that readers see, and the next one is whole.
    with pytest.raises(Exception):
        table.sync(rows({1: "x"}), lambda todo: todo.withColumn("by", F.raise_error(F.lit("stopped")).cast("string")))
    assert table.manifest()[0] == 2 and table.read().filter("by = 'three'").count() == 0
    table.sync(rows({1: "x"}), embed("four"))
    assert {r.id for r in table.read().filter("by = 'four'").collect()} == {"k1", "k7", "k8"}
    table.sync(rows({}).filter("false"), embed("five"))
    assert table.read().count() == 0 and table.manifest()[1] == {}
    with pytest.raises(ValueError):
        Snapshot(spark, at, schema, 8).manifest()


def test_round_trips_and_jobs(spark, tmp_path):
    good, _ = parsed(spark)
    articles = good.drop("page_id", "pos")
    tables.write_records(articles, f"{tmp_path}/a", "json")
    back = tables.read_records(spark, f"{tmp_path}/a", schemas.ARTICLE)
    assert {r.number: r.units for r in back.collect()} == {r.number: r.units for r in articles.collect()}
    log = f"{tmp_path}/log"
    assert tables.read_log(spark, log, schemas.ANSWER_LOG).count() == 0
    for batch in ("a", "b", "a"):
        added = tables.append_log(spark.createDataFrame([(f"{batch}{i}", "m", 0) for i in range(9)], "id string, model string, seq long").repartition(3), log, batch)
    assert not added and {r.id for r in tables.read_log(spark, log, schemas.ANSWER_LOG).filter("seq < 9").collect()} == {f"a{i}" for i in range(9)}
    assert sorted(r.seq for r in tables.read_log(spark, log, schemas.ANSWER_LOG).collect()) == list(range(18))
    # A batch whose job failed has no mark of its end, and is written over.
    (tmp_path / "log" / "batch-b" / "_SUCCESS").unlink()
    with pytest.raises(ValueError):
        tables.append_log(spark.range(1), log, "../x")
    (tmp_path / "act.html").write_text(PAGE, encoding="utf-8")
    (tmp_path / "act.meta.json").write_text('{"slug": "act", "name": "Actul", "short_ref": "L", "doc_id": 3, "url": "u", "consolidation_date": null}', encoding="utf-8")
    pages = tables.read_pages(spark, f"{tmp_path}/*.html", f"{tmp_path}/*.meta.json")
    assert pages.first().html == PAGE
    (tmp_path / "alone.html").write_text(PAGE, encoding="utf-8")
    pages = tables.read_pages(spark, f"{tmp_path}/*.html", f"{tmp_path}/*.meta.json")
    _, chunks, quarantine = build_corpus.build(pages.drop("n_articles").withColumn("page_id", F.xxhash64("slug")))
    assert chunks.count() == 2 and sorted(r.problem for r in quarantine.collect()) == ["no heading", "no metadata"]
    empty = spark.createDataFrame([], "id string, embedding array<float>, text string, law_slug string, law_ref string, article string, part int, hash string")
    assert build_corpus.next_vectors(empty, chunks, models.hashing_encoder()).count() == 2
    rows = chunking.searchable(chunks)
    # Two chunks alone would make each term as common as not, with an idf of 0.
    rows = rows.unionByName(rows.withColumns({"chunk_id": F.concat("chunk_id", F.lit("x")), "article": F.concat("article", F.lit("x")), "text": F.lit("altceva")}))
    asked = spark.createDataFrame([("q", "Statul nostru este unul"), ("z", "nimic")], "qid string, question string")
    hits = answer_batch.ranked(asked, rows)
    assert hits.filter("qid = 'q' and rank = 1").first().article == "3"
    stored = postings.postings(lexical.token_index(rows, stems=True))
    same = lambda df: sorted(repr(r) for r in df.collect())
    assert same(answer_batch.ranked(asked, rows, found=stored)) == same(hits)
    assert answer_batch.prompts(asked, rows, hits).filter("qid = 'q'").first().prompt.startswith("SURSE:\n\n[1] Actul (L)")
