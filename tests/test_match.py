"""Search, rules and cascades on a small catalog, against a plain scan."""

import random

import pytest
from pyspark.sql import functions as F

from tessel.functions import similarity as K
from tessel.functions import text as T
from tessel.operators import blocking, ranking, rules
from tessel.plans import cascade, report
from tessel.sources import cache, catalog

ITEMS = [
    ("101", "PAN 40 TAB", "ALKEM", "strip of 10 tablets"), ("102", "PAN D CAP", "ALKEM", "strip of 15 capsules"), ("103", "PANTOP 40 TAB", "ARISTO", "10S"),
    ("104", "DOLO 650 TAB", "MICRO LABS", "15 TAB"), ("105", "CALPOL 500 TAB", "GSK", "15 TAB"), ("106", "CALPOL 650 TAB", "GSK", "15 TAB"),
    ("107", "AUGMENTIN 625 DUO TAB", "GLAXO SMITHKLINE", "10 TAB"), ("108", "PAN 40 INJ", "ALKEM", "1 vial"), ("109", "CALPOL SYRUP 60ML", "GSK", "bottle of 60 ml"),
    ("110", "36 D CAPS", "OTHER", "10 CAP"), ("111", "PAN 40 TAB", "ALKEM", "strip of 10 tablets"),
]
ASKED = [
    (1, "PAN 40 TAB", "10S", "ALKEM"), (2, "RS-PAN 40 TAB", "10 TAB", ""), (3, "DOLO650", "15 TAB", "MICRO"), (4, "CALPOL 650", "", "GSK"),
    (5, "AUGMENTIN 625 DUO", "", "GSK"), (6, "XY PNTOP 40 TAB", "", ""), (7, "", "", ""), (8, None, None, None), (9, "PAN 40 INJ", "", ""), (10, "ZZZQ", "", ""), (11, "36 D CAPS", "", ""),
]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, *x[:2], x[2], x[3]) for i, x in enumerate(ITEMS, 1)]
    df = spark.createDataFrame(rows, "item_id bigint, code string, name string, compname string, pack string").withColumn("strength", T.strength("name"))
    return blocking.prepared(df).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id bigint, name string, pack string, compname string")


def test_candidates_are_those_of_a_scan(spark, items, asked):
    q = asked.select(T.search_form("name").alias("norm"))
    got = {(r.norm, r.item_id) for r in blocking.candidates(q, items).collect()}
    rows = items.select("item_id", "norm", "comp_norm").collect()
    want = set()
    for (norm,) in q.distinct().collect():
        for index in ("norm", "comp_norm"):
            keys = {}
            for r in sorted(rows, key=lambda r: r.item_id):
                if r[index]:
                    keys.setdefault(r[index].split()[0][:3], []).append(r.item_id)
            for w in norm.split():
                if w.replace(".", "", 1).isdigit():
                    continue
                p = w[:3]
                like = sorted((k for k in keys if K.ratio_of(p, k) >= 60), key=lambda k: -K.ratio_of(p, k))[:40]
                for k in {*like, *([p] if p in keys else []), *(k for k in keys if len(p) < 3 and k.startswith(p))}:
                    want |= {(norm, i) for i in keys[k]}
    assert got == want


def test_search_ranks(items, asked):
    rows = ranking.search(asked, items).collect()
    best = {r.query_id: r for r in rows if r["rank"] == 1}
    assert best[1].code == "101" and best[1].final_score == 100 * 0.75 + 90 * 0.25 + 10
    assert best[2].code == "101" and best[3].code == "104" and best[4].code == "106"
    assert best[9].code == "101"  # dosage forms play no part before the rules
    assert 7 not in best and 8 not in best
    for q in {r.query_id for r in rows}:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) <= 5
        assert all(a.final_score >= b.final_score for a, b in zip(own, own[1:]))


def test_ties_go_to_the_earlier_item(items, asked):
    codes = [r.code for r in ranking.search(asked.filter("query_id = 1"), items).orderBy("rank").collect()]
    assert codes.index("101") < codes.index("111")


def test_second_search(items, asked):
    rows = ranking.search_twice(asked, items).collect()
    assert max(r["rank"] for r in rows) <= 8
    assert {r.query_id for r in rows} >= {1, 2, 3, 4, 5, 6, 9}


def test_batch_flow(items, asked):
    got = {r.query_id: r for r in cascade.run(asked, items, cascade.BATCH).collect()}
    assert len(got) == len(ASKED)
    assert got[1].code == "101" and got[1].method == "Heuristic"
    assert got[4].code == "106" and got[3].code == "104" and got[9].code == "108"
    assert got[7].code is None and got[8].code is None and got[10].code is None and got[10].method == "No Match"
    assert got[11].code is None  # a number is no key, and neither name nor company starts like D


def test_server_flow_drops_what_no_model_confirms(items, asked):
    sure = {r.query_id for r in cascade.run(asked, items, cascade.SERVER).filter("code is not null").collect()}
    every = {r.query_id for r in cascade.run(asked, items, cascade.BATCH).filter("code is not null").collect()}
    assert {3, 4, 9} <= sure < every


def test_reranker_is_guarded(items, asked):
    first = cascade.PromptReranker(ask=lambda prompt: '{"match_number": 1}')
    got = {r.query_id: r for r in cascade.run(asked, items, cascade.SERVER, first).collect()}
    assert got[3].method == "Heuristic" and got[1].method == "AI Match" and got[1].code == "101"
    assert got[10].code is None


def test_verification(items, asked):
    yes = cascade.PromptReranker(ask=lambda prompt: "yes")
    got = {r.query_id: r for r in cascade.run(asked, items, cascade.OLD_SERVER, yes).collect()}
    assert "Verified" in {r.method for r in got.values()} and got[10].code is None


def test_answers():
    assert cascade.parsed_choice('so\n```json\n{"match_number": 2}\n```', 3) == 2
    assert cascade.parsed_choice('{"match_number": null}', 3) is None
    assert cascade.parsed_choice('{"match_number": 9}', 3) is None
    assert cascade.parsed_choice("nothing {", 3) is None


@pytest.mark.parametrize("flow", [cascade.OLD_SERVER, cascade.HYBRID])
def test_other_flows(items, asked, flow):
    got = {r.query_id: r.code for r in cascade.run(asked, items, flow).collect()}
    assert got[3] == "104" and got[10] is None


def test_browser_flow(items, asked):
    got = {r.query_id: r.code for r in cascade.run_browser(asked, items).collect()}
    assert got[1] == "101" and got[10] is None and len(got) == len(ASKED)


def plain_browse(asked, catalog, least, top_k):
    """The browser's search pair by pair; rows are (id, name, pack, compname) of lower-cased plain words."""
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    like = lambda t, x: min(len(t), len(x)) >= 3 and 2 * len(pairs(t) & pairs(x)) / (len(pairs(t)) + len(pairs(x))) >= 0.7
    out = set()
    for qid, name, pack, _ in asked:
        hits, q = [], name.split()
        for iid, text, i_pack, comp in catalog:
            if q[0] not in text and q[0] not in comp:
                continue
            t, n = text.split(), [0, 0, 0]
            for w in q:
                first = next((x for x in t if x.startswith(w)), None)
                if first or any(like(w, x) for x in t):
                    n[0 if first == w else 1 if first else 2] += 1
            front = next((k for k, (x, y) in enumerate(zip(q, t)) if x != y), min(len(q), len(t)))
            packs = 50 if not (pack and i_pack) else 100 if pack == i_pack else 80 if pack in i_pack or i_pack in pack else 50
            matched = n[0] + n[1] + n[2] * 0.8
            score = (matched / len(q) * 60 + n[0] / len(q) * 20 + front * 20) * 0.75 + packs * 0.25
            if score >= least:
                hits.append((-round(matched, 1), -front, -score, iid))
        out |= {(qid, rank, h[3], round(-h[2], 6), -h[0], -h[1]) for rank, h in enumerate(sorted(hits)[:top_k], 1)}
    return out


@pytest.mark.parametrize("top_k", [1, 4, None])
def test_browser_search_is_the_search_pair_by_pair(spark, monkeypatch, top_k):
    """Copies of names and packs, ties, several cells; what leaves a cell follows the hits and not the pairs."""
    monkeypatch.setattr(ranking, "CELL_QUERIES", 7)
    monkeypatch.setattr(ranking, "CELL_NAMES", 11)
    made, plain = [], ranking.browsed
    monkeypatch.setattr(ranking, "browsed", lambda *a: made.append(plain(*a)) or made[-1])
    rng = random.Random(3)
    words = ["red", "redding", "reds", "hot", "blue", "bluer", "xred", "12", "120", "gear", "gears", "ge"]
    row = lambda i: (i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice(["", "10s", "10", "5s"]), rng.choice(["red house", "other"]))
    asked, catalog = [r for r in map(row, range(150)) if len(r[1]) >= 2], [row(i) for i in range(400)]
    q = spark.createDataFrame(asked, "query_id bigint, name string, pack string, compname string")
    c = spark.createDataFrame([(r[0], str(r[0]), *r[1:]) for r in catalog], "item_id bigint, code string, name string, pack string, compname string")
    c = blocking.prepared(c.withColumn("strength", T.strength("name")))
    got = ranking.browser_search(q, c, 35, top_k).select("query_id", "rank", "item_id", "score", "matched", "front").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_browse(asked, catalog, 35, top_k)
    if top_k == 1:
        pairs = sum(r[1].split()[0] in i[1] or r[1].split()[0] in i[3] for r in asked for i in catalog)
        assert made[0].count() < pairs / 5


def test_report(spark, items, asked, tmp_path):
    rows = report.report(asked, cascade.run(asked, items, cascade.BATCH)).cache()
    total = report.summary(rows).first()
    assert total.total == len(ASKED) and total.matched + total.unmatched == total.total
    h = report.histogram(rows).first()
    assert sum(h) == rows.filter("confidence > 0").count()
    paths = report.write_sheets(rows, str(tmp_path / "out"))
    assert len(paths) == 3 and spark.read.parquet(paths[0]).count() == len(ASKED)
    report.write_parts(rows, 3, str(tmp_path / "parts"))
    parts, lost = [str(tmp_path / "parts" / f"part={i}") for i in (1, 2, 3)] + [str(tmp_path / "gone")], []
    merged = report.merge(spark, parts, left_out=lost)
    assert lost == parts[-1:]
    with pytest.raises(Exception):
        report.merge(spark, parts)
    assert merged["all_results"].count() == len(ASKED)
    order = [r.confidence for r in merged["all_results"].collect()]
    n = sum(c > 0 for c in order)
    assert order[:n] == sorted(order[:n]) and all(c == 0 for c in order[n:])
    assert report.mappings(asked, cascade.run(asked, items)).count() == total.matched


def test_cache(spark, items, asked, tmp_path):
    store = cache.ResultCache(spark, str(tmp_path / "cache"))
    assert store.lookup(asked, items).count() == 0
    store.save(asked, cascade.run(asked, items, cascade.HYBRID))
    hits = {r.query_id: r.code for r in store.lookup(asked, items).collect()}
    assert hits[1] in ("101", "111") and 10 not in hits
    store.save(asked, cascade.run(asked, items, cascade.HYBRID))
    assert store.latest().count() == store.latest().select("query_normalized").distinct().count()


def test_cache_of_two_writers(spark, asked, tmp_path):
    """Batches that know nothing of each other: the one saved later counts, and no store is read to add one."""
    one, two = (cache.ResultCache(spark, str(tmp_path / "cache")) for _ in range(2))
    q = asked.filter("query_id = 1")
    result = lambda code: q.select("query_id", F.lit(code).alias("code"), F.lit("n").alias("m_name"))
    one.save(q, result("101"))
    two.save(q, result("102"))
    assert [r.matched_code for r in one.latest().collect()] == ["102"]
    one.save(q, result(None))
    assert [r.matched_code for r in two.latest().collect()] == [cache.MISS]


def test_cached_flow(spark, items, asked, tmp_path):
    store = cache.ResultCache(spark, str(tmp_path / "flow"))
    one = {r.query_id: (r.code, r.method) for r in cascade.run_cached(asked, items, store).collect()}
    two = {r.query_id: (r.code, r.method) for r in cascade.run_cached(asked, items, store).collect()}
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()}
    assert all((two[k][1] == "Cache") == (v[0] is not None) for k, v in one.items())
    assert ranking.clamped(0) == 1 and ranking.clamped(99) == 20


def test_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿CODE,Name,COMPNAME,Pack\n 1 ,PAN 40,ALKEM,10S\n,NO CODE,,\n3,,X,\n4,DOLO 650,,\n", encoding="utf-8")
    rows = catalog.read_catalog(spark, str(tmp_path / "c.csv")).orderBy("item_id").collect()
    assert [(r.item_id, r.code, r.name, r.strength) for r in rows] == [(1, "1", "PAN 40", ""), (2, "4", "DOLO 650", "")]
    (tmp_path / "f.csv").write_text("Material Description,Brands\nPAN 40MG,ALKEM\nNAME,x\n----,y\nDOLO 650,\n", encoding="utf-8")
    rows = catalog.read_foreign_catalog(spark, str(tmp_path / "f.csv")).orderBy("item_id").collect()
    assert [(r.code, r.name, r.compname, r.strength) for r in rows] == [("M_1", "PAN 40MG", "ALKEM", "40MG"), ("M_2", "DOLO 650", "", "650")]
    (tmp_path / "v.csv").write_text("name,Pack,Compname\nPAN 40,nan,None\nname,,\nDOLO,10S,X\n", encoding="utf-8")
    rows = catalog.read_vendor(spark, str(tmp_path / "v.csv"), limit=1).collect()
    assert [(r.query_id, r.name, r.pack, r.compname) for r in rows] == [(1, "PAN 40", "", "")]
    (tmp_path / "j.json").write_text('{"catalog": [{"master_id": "7", "name": "PAN 40MG", "company": "A", "pack": null}, {"code": "8", "name": "X"}, {"name": "no code"}]}')
    rows = catalog.read_json_catalog(spark, str(tmp_path / "j.json")).orderBy("item_id").collect()
    assert [(r.code, r.strength) for r in rows] == [("7", "40MG"), ("8", "")]
    assert catalog.read_json_catalog(spark, str(tmp_path / "none.json"), str(tmp_path / "c.csv")).count() == 2
    with pytest.raises(Exception):
        catalog.read_catalog(spark, str(tmp_path / "missing.csv")).count()
    (tmp_path / "bad.json").write_text('{"catalog": [')
    with pytest.raises(Exception):
        catalog.read_json_catalog(spark, str(tmp_path / "bad.json"), str(tmp_path / "c.csv")).count()


def test_stream(spark, items, asked, tmp_path):
    from tessel.streaming import match

    asked.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = match.match_stream(stream, items, str(tmp_path / "out"), str(tmp_path / "ck"), progress_path=str(tmp_path / "pr"), total=len(ASKED)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ASKED)
    assert match.progress(spark, str(tmp_path / "pr")).agg(F.min("remaining")).first()[0] == 0


def test_empty_tables(spark, items, asked):
    none = asked.limit(0)
    assert cascade.run(none, items).count() == 0
    assert cascade.run(asked, items.limit(0)).filter("code is not null").count() == 0
    assert rules.first_accepted(rules.judged(cascade.candidate_rows(none, ranking.search(none, items)))).count() == 0


def test_search_is_a_scan_of_definitions(items, asked):
    """Every score of every hit, and that no better item was passed over."""
    q = {r.query_id: r for r in asked.select("query_id", T.search_form("name").alias("norm"), T.tokens("name").alias("tokens"), T.search_form("compname").alias("comp"), F.lit(0).alias("p")).collect()}
    every = items.select("item_id", "norm", "tokens", "comp_norm", "pack").collect()
    reach = {(r.norm, r.item_id) for r in blocking.candidates(asked.select(T.search_form("name").alias("norm")), items).collect()}
    packs = {(r.query_id, r.item_id): r.s for r in asked.join(items.select("item_id", F.col("pack").alias("ip"))).select("query_id", "item_id", ranking.pack_score(ranking.pack_side("pack"), ranking.pack_side("ip")).alias("s")).collect()}
    got = {}
    for r in ranking.search(asked, items).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.final_score))
    for i, r in q.items():
        want = []
        for it in every:
            stage = K.token_set_ratio_of(r.norm, it.norm)
            if (r.norm, it.item_id) not in reach or stage < 50:
                continue
            brand = r.tokens[1] if len(r.tokens[0]) <= 2 and len(r.tokens) > 1 else r.tokens[0]
            known = brand in it.norm or brand in it.comp_norm or any(K.ratio_of(brand, w) >= 75 for w in it.norm.split() + it.comp_norm.split())
            like = K.partial_ratio_of(r.comp, it.comp_norm) if r.comp and it.comp_norm else 50
            final = stage * (0.65 if len(brand) > 2 and not known else 1) * 0.75 + packs[i, it.item_id] * 0.25 + (10 if like >= 60 else -15 if like < 30 else 0)
            want.append((-final, [-x for x in ranking.token_features_of(r.tokens, it.tokens)], it.item_id))
        want = sorted(want)[:5]
        assert [(k, n) for k, (_, _, n) in enumerate(want, 1)] == [(k, n) for k, n, _ in sorted(got.get(i, []))]
        assert all(abs(-w[0] - g[2]) <= 0.0501 for w, g in zip(want, sorted(got.get(i, []))))


def test_workbook_round_trip(spark, tmp_path):
    from tessel.sources import workbook

    rows = [(1, "a & <b> \"c\"", 2.5, True), (2, None, None, None), (30, "  x\ny é🎉 ", -1.0, False), (4, "long " * 30, 1e20, None)]
    df = spark.createDataFrame(rows, "n int, t string, d double, b boolean").orderBy("n")
    path = f"file://{tmp_path}/w.xlsx"
    workbook.write(spark, path, {"One": df, "Two & more": df.filter("n = 4").select("t")})
    got = [tuple(r) for r in workbook.read(spark, path).collect()]
    assert got == [("1", rows[0][1], "2.5", "True"), ("2", None, None, None), ("4", rows[3][1], "1e+20", None), ("30", rows[2][1], "-1", "False")]
    assert [r.t for r in workbook.read(spark, path, "Two & more").collect()] == [rows[3][1]]


def test_workbook_of_another_writer(spark, tmp_path):
    """Shared strings, rich text, gaps, and an absolute target."""
    import zipfile

    from tessel.sources import catalog, workbook

    main, rel = workbook.MAIN, workbook.RELATIONS
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbook.PACKAGE}/relationships"><Relationship Id="rId7" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Material Description</t></si><si><r><t>PAN </t></r><r><t>40MG</t></r><rPh><t>no</t></rPh></si><si><t>Brands</t></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>2</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>12.0</v></c></row><row r="3"/><row r="4"><c r="A4" t="str"><v>----</v></c></row></sheetData></worksheet>')
    rows = catalog.read_foreign_catalog(spark, f"file://{tmp_path}/x.xlsx", "xlsx").collect()
    assert [(r.code, r.name, r.compname, r.strength) for r in rows] == [("M_1", "PAN 40MG", "12", "40MG")]


def test_batch_job(spark, items, asked, tmp_path):
    from tessel import batch
    from tessel.sources import workbook

    items.select("code", "name", "compname", "pack", "strength").coalesce(1).write.option("header", True).csv(f"{tmp_path}/c.csv")
    asked.filter("name != ''").orderBy("query_id").select(F.col("query_id").cast("string").alias("code"), "name", F.col("pack").alias("Pack"), F.col("compname").alias("Compname")).coalesce(1).write.option("header", True).csv(f"{tmp_path}/v.csv")
    sums = batch.run(spark, f"{tmp_path}/v.csv", f"{tmp_path}/c.csv", f"{tmp_path}/out.xlsx")
    assert sums.total == 9 and sums.matched + sums.unmatched == 9 and sums.items_per_s > 0 and sums.high + sums.medium + sums.low <= sums.matched
    every = workbook.read(spark, f"file://{tmp_path}/out.xlsx", "All Results").collect()
    assert len(every) == 9 and {r["Input Name"]: r["Matched Code"] for r in every}["DOLO650"] == "104"
    assert workbook.read(spark, f"file://{tmp_path}/out.xlsx", "Not Matched").count() == sum(r["Confidence %"] == "0" for r in every)
    small = batch.run(spark, f"{tmp_path}/v.csv", f"{tmp_path}/c.csv", f"{tmp_path}/out", limit=4, parts=2)
    assert small.total == 4 and spark.read.parquet(f"{tmp_path}/out/parts").count() == 4
