"""The registered queries of the matching engine, and their SQL for an independent engine.

The tables have no product catalog, so one is made of `part`: the same SQL text
makes catalog and vendor rows on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dialog as D
from .functions import lexicon as L
from .functions import similarity as K
from .functions import text as T
from .operators import blocking, ranking, rules
from .plans import cascade, report
from .sources import cache, catalog
from .storage import new_folder, written
from .streaming import match

#: Expressions that both engines read alike.
_SIZE = "cast(p_size as string)"
CATALOG = f"""select cast(p_partkey as bigint) as item_id, cast(p_partkey as string) as code,
  p_name || ' ' || {_SIZE} || ' MG' || case when p_partkey % 3 = 0 then ' TAB' when p_partkey % 3 = 1 then ' INJ' else '' end as name,
  p_brand || ' Pharma Ltd' as compname,
  case when p_partkey % 4 = 0 then 'strip of ' || {_SIZE} || ' tablets' when p_partkey % 4 = 1 then '1*' || {_SIZE} || 'G' when p_partkey % 4 = 2 then {_SIZE} || 'S' else 'bottle of ' || {_SIZE} || ' ml Syrup' end as pack
  from part"""
VENDOR = f"""select cast(p_partkey as bigint) as query_id, cast(p_partkey as string) as code,
  case when p_partkey % 8 = 0 then 'RS-' || upper(p_name) || ' ' || {_SIZE} || ' MG TAB'
    when p_partkey % 8 = 1 then upper(substr(p_name, 1, 2)) || substr(p_name, 4) || ' ' || {_SIZE} || 'MG'
    when p_partkey % 8 = 2 then lpad({_SIZE}, 3, '0') || ' ' || p_name || ' INJ ' || {_SIZE}
    when p_partkey % 8 = 3 then p_name || ' SYRUP ' || {_SIZE} || 'ML.'
    when p_partkey % 8 = 4 then p_name || ' FORTE SR ' || {_SIZE} || '/' || cast(p_size * 2 as string) || 'MG'
    when p_partkey % 8 = 5 then p_name || ' ' || {_SIZE}
    when p_partkey % 8 = 6 then upper(p_name) || {_SIZE} || '.50MG CAP,' || {_SIZE}
    else p_name || '-' || p_type || '/' || {_SIZE} end as name,
  case when p_partkey % 5 = 0 then '10 TAB' when p_partkey % 5 = 1 then {_SIZE} || 'S' when p_partkey % 5 = 2 then 'S ' || {_SIZE} when p_partkey % 5 = 3 then '' else '3*' || {_SIZE} || ' ML' end as pack,
  case when p_partkey % 6 = 0 then '' when p_partkey % 6 = 1 then 'BRAND ' || substr(p_brand, 7) when p_partkey % 6 = 2 then '--' else p_brand end as compname
  from part"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))


def vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(spark, sf_dir, VENDOR)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(blocking.prepared(_made(spark, sf_dir, CATALOG).withColumn("strength", T.strength("name"))), "items")


def all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t: names of vendor rows and of catalog items."""
    return vendor(spark, sf_dir).select(F.concat(F.lit("v"), "code").alias("id"), F.col("name").alias("t")).union(_made(spark, sf_dir, CATALOG).select(F.concat(F.lit("c"), "code"), "name"))


_NAMES = f"names as (select 'v' || code as id, name as t from ({VENDOR}) union all select 'c' || code, name from ({CATALOG}))"


# --- text functions ---


def text_normalisers(spark, sf_dir):
    return all_names(spark, sf_dir).select("id", T.search_form("t").alias("t1"), T.match_form("t").alias("t2"), T.old_match_form("t").alias("t2b"), T.raw_query("t").alias("t3"), T.raw_query("t", False).alias("t3b"), T.browser_form("t").alias("t5"))


def text_tokenisers(spark, sf_dir):
    return all_names(spark, sf_dir).select("id", F.array_join(T.tokens("t"), "|").alias("t4"), F.array_join(T.browser_tokens("t"), "|").alias("t6"))


def strength_extraction(spark, sf_dir):
    return all_names(spark, sf_dir).select("id", T.strength("t").alias("str1"), T.strength("t", False).alias("str1b"))


def dose_numbers(spark, sf_dir):
    n = F.element_at(T.numbers("t"), -1)
    return all_names(spark, sf_dir).select("id", F.array_join(T.numbers("t"), "|").alias("str3"), F.array_join(F.array_sort(T.dose_numbers("t")), "|").alias("str4"), T.has_unit("t", n).alias("str2"))


def pack_parser(spark, sf_dir):
    both = vendor(spark, sf_dir).select(F.concat(F.lit("v"), "code").alias("id"), "pack").union(_made(spark, sf_dir, CATALOG).select(F.concat(F.lit("c"), "code"), "pack"))
    return both.select("id", "pack", T.pack("pack").qty.alias("qty"), T.pack("pack").unit.alias("unit"))


def companies(spark, sf_dir):
    made = spark.sql(_COMPANIES.replace("from part", "from {part}"), part=table(spark, sf_dir, "part"))
    return made.select("id", T.company("a").alias("clean"), T.initials("a").alias("initials"), T.is_acronym("b", "a").alias("acronym"))


_COMPANIES = "select cast(p_partkey as bigint) as id, upper(substr(p_name, 1, 1)) || substr(p_name, 2) || p_type || ' Pharma (India) Pvt. Ltd' as a, case when p_partkey % 2 = 0 then upper(substr(p_name, 1, 1)) || substr(p_type, 1, 1) else substr(p_type, 1, 2) end as b from part"


def suffix_sets(spark, sf_dir):
    return all_names(spark, sf_dir).select("id", F.array_join(T.suffixes("t"), "|").alias("suf1"), F.array_join(T.suffixes("t", L.OLD_SUFFIXES), "|").alias("suf1b"))


def forms(spark, sf_dir):
    v, c = vendor(spark, sf_dir), _made(spark, sf_dir, CATALOG)
    pairs = v.select("query_id", F.concat_ws(" ", "name", "pack").alias("q")).join(c.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "name", "pack").alias("c")), "query_id")
    return pairs.select("query_id", T.form("q").alias("q_form"), T.form("c").alias("c_form"), rules.forms_compatible("q", "c").alias("compatible"))


# --- dialogs ---


def answers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("<think>it is {\"k\": 1}</think>\n\nResult:\n```json\n"), "props", F.lit("\n```"))
    return e.select("event_id", D.chosen_number(T.without_thoughts(text), F.lit(50), "k").cast("bigint").alias("number"))


_SYSTEM = "You match products."


def chat_prompts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    out = None
    for name in L.PROMPTS:
        one = D.prompts(turns, name, _SYSTEM).select("conv_id", F.lit(name).alias("template"), "prompt")
        out = one if out is None else out.union(one)
    return out


def history_trimming(spark, sf_dir):
    return D.trimmed(table(spark, sf_dir, "conversations"), "chatml", _SYSTEM).select("conv_id", "turn")


def answer_pieces(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(D.pieces("text"))).select("conv_id", "turn", F.col("pos").cast("bigint").alias("n"), F.col("col").alias("piece"))


# --- similarity ---


def _name_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    t = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", F.substring_index("p_name", " ", 1), F.substring("p_name", 2, 5)).alias("b"), F.substring("p_name", 1, 1).alias("k")).distinct()
    # each distinct name against the distinct texts that share its first letter
    return n.withColumn("k", F.substring("a", 1, 1)).join(t, "k").select("a", "b")


_PAIRS = "pairs as (select a, b from (select distinct p_name as a from part) n join (select distinct p_type || ' ' || split_part(p_name, ' ', 1) || ' ' || substr(p_name, 2, 5) as b, substr(p_name, 1, 1) as k from part) t on substr(a, 1, 1) = k)"


def similarity_ratios(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return _name_pairs(spark, sf_dir).select("a", "b", K.lcs(a, b).cast("bigint").alias("k0"), K.short_lcs(a, b).cast("bigint").alias("k0_native"), F.bround(K.ratio(a, b), 6).alias("k1"), F.bround(K.token_sort_ratio(a, b), 6).alias("k3"), F.bround(K.token_set_ratio(a, b), 6).alias("k4"))


def partial_ratios(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.bround(K.partial_ratio(F.col("a"), F.col("b")), 6).alias("k2"))


def letter_pairs(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("a", "b", F.bround(K.dice(F.col("a"), F.col("b")), 9).alias("k7"))


def abbreviations(spark, sf_dir):
    n = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.substring("p_name", 1, 1), F.translate("p_name", "aeiou ", "").substr(2, 3)).alias("s"))
    return n.select("p_partkey", T.is_abbreviation("s", "p_name").alias("k8"), T.is_abbreviation(F.reverse("s"), F.col("p_name")).alias("k8_reversed"))


def alias_relation(spark, sf_dir):
    """Each fixed alias edge, looked up in both directions and through a shared alias."""
    e = rules.aliases(spark)
    pairs = e.select(F.col("brand").alias("x"), F.col("alias").alias("y")).union(e.alias("p").join(e.alias("q"), F.col("p.alias") == F.col("q.alias")).select("p.brand", "q.brand")).distinct()
    return pairs.select("x", "y", rules.brands_equivalent("x", "y").alias("j10"), F.size(rules.brand_aliases("x")).cast("bigint").alias("n_aliases"))


# --- sources ---


def catalog_cleaning(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.when(F.col("p_size") == 1, "----").when(F.col("p_size") == 2, "Name").when(F.col("p_size") == 3, None).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mg"))).alias("Material Description"), F.col("p_brand").alias("Brands"), "p_partkey")
    clean = catalog.derived(raw.drop("p_partkey"))
    return clean.select("name", "compname", "pack", "strength").groupBy("name", "compname", "pack", "strength").agg(F.count(F.lit(1)).alias("n"))


def range_split(spark, sf_dir):
    return report.split(table(spark, sf_dir, "part").select("p_partkey"), 7, "p_partkey").select("p_partkey", F.col("part").cast("bigint").alias("part"))


def _file(spark: SparkSession, df: DataFrame, kind: str, tag: str, **options) -> str:
    """df as one file of a kind that sources read, in its order."""
    path = new_folder(spark, tag)
    df.coalesce(1).write.options(**options).format(kind).save(path)
    return path


def _catalog_rows(spark, sf_dir) -> DataFrame:
    """Catalog rows in order of the key; some without a code, some without a name."""
    c = _made(spark, sf_dir, CATALOG).orderBy("item_id")
    return c.select(F.when(F.col("item_id") % 11 == 0, "").otherwise(F.concat(F.lit(" "), "code")).alias("CODE"), F.when(F.col("item_id") % 13 == 0, None).otherwise(F.col("name")).alias("Name"), F.concat(F.lit('"A, B" '), "compname").alias("COMPNAME"), F.col("pack").alias("Pack"))


def csv_catalog(spark, sf_dir):
    """IO1: quoted cells, headers of any case, rows without code or name left out, numbered in input order."""
    return catalog.read_catalog(spark, _file(spark, _catalog_rows(spark, sf_dir), "csv", "csv", header=True, escape='"'))


def foreign_catalog(spark, sf_dir):
    """IO2, IO4: foreign headers, echoes of the header left out, codes and strengths made."""
    raw = table(spark, sf_dir, "part").orderBy("p_partkey").select(F.when(F.col("p_size") == 1, "----").when(F.col("p_size") == 2, "NAME").otherwise(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("mg"))).alias("Material Description"), F.col("p_brand").alias("Brands"), F.col("p_type").alias("Pack Size Per Strip"))
    return catalog.read_foreign_catalog(spark, _file(spark, raw, "csv", "foreign", header=True)).select("item_id", *catalog.FIELDS)


def json_catalog(spark, sf_dir):
    """IO6: one document with all items, by either name of the code."""
    c = _made(spark, sf_dir, CATALOG).groupBy((F.col("item_id") % 3).alias("k")).agg(F.array_sort(F.collect_list(F.struct("item_id", F.when(F.col("item_id") % 2 == 0, F.col("code")).alias("master_id"), F.when(F.col("item_id") % 2 == 1, F.col("code")).alias("code"), "name", F.col("compname").alias("company"), "pack"))).alias("catalog")).orderBy("k").drop("k")
    return catalog.read_json_catalog(spark, _file(spark, c, "json", "json", compression="none"), lines=True).drop("item_id")


def vendor_file(spark, sf_dir):
    """IO8, IO9: a vendor's file with placeholders and a limit of rows."""
    v = vendor(spark, sf_dir).orderBy("query_id").select("code", F.when(F.col("query_id") % 17 == 0, "name").otherwise(F.col("name")).alias("name"), F.when(F.col("query_id") % 3 == 0, "nan").otherwise(F.col("pack")).alias("Pack"), F.when(F.col("query_id") % 4 == 0, "None").otherwise(F.col("compname")).alias("Compname"))
    return catalog.read_vendor(spark, _file(spark, v, "csv", "vendor", header=True), limit=150)


def vendor_requests(spark, sf_dir):
    """IO7: requests with lists of products."""
    r = vendor(spark, sf_dir).select((F.col("query_id") % 5).alias("k"), F.struct("query_id", "name", "pack", F.col("compname").alias("company"), F.when(F.col("query_id") % 2 == 0, F.col("code")).alias("code")).alias("p"))
    return catalog.products(r.groupBy("k").agg(F.array_sort(F.collect_list("p")).alias("products"))).drop("query_id")


def merged_parts(spark, sf_dir):
    """IO12, IO13: rows split into files and merged again, one of them lost."""
    rows = vendor(spark, sf_dir).select("query_id", "name", (F.col("query_id") % 101).cast("int").alias("confidence"))
    path = new_folder(spark, "parts")
    report.write_parts(rows, 4, path)
    return report.merge(spark, [f"{path}/part={i}" for i in (1, 2, 4, 9)], left_out=[])["matched"]


def cache_lookup(spark, sf_dir):
    """IO14, J9: two batches of results, of which the later counts, looked up for queries whose item is still there."""
    v = vendor(spark, sf_dir)
    it = _made(spark, sf_dir, CATALOG).filter("item_id % 10 != 3")
    store = cache.ResultCache(spark, new_folder(spark, "cache"))
    as_match = lambda df, shift: df.select("query_id", F.when(F.col("query_id") % 6 != shift, F.col("code")).alias("code"), F.col("name").alias("m_name"))
    store.save(v, as_match(v, 0))
    late = v.filter("query_id % 4 = 0")
    store.save(late, as_match(late, 2))
    return store.lookup(v, it)


def streamed_reports(spark, sf_dir):
    """IO16: a stream of vendor files matched batch by batch; what has been processed in the end."""
    v, it, at = vendor(spark, sf_dir), items(spark, sf_dir), new_folder(spark, "stream")
    v.repartitionByRange(2, "query_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    q = match.match_stream(stream, it, f"{at}/out", f"{at}/checkpoint", progress_path=f"{at}/progress", total=v.count()).trigger(availableNow=True).start()
    q.awaitTermination()
    last = match.progress(spark, f"{at}/progress").agg(F.max("processed").alias("processed"), F.max("matched").alias("matched"), F.min("remaining").alias("remaining"))
    return last


# --- candidates and search ---


def prefix_index(spark, sf_dir):
    return blocking.posting_lists(blocking.classes(items(spark, sf_dir)))


def like_keys(spark, sf_dir):
    it = items(spark, sf_dir)
    q = vendor(spark, sf_dir).select(T.search_form("name").alias("norm"))
    probes = blocking.query_words(q).select("probe").distinct()
    return blocking.probes_to_keys(probes, blocking.posting_lists(blocking.classes(it)).select("idx", "key", "first_item"))


def candidate_counts(spark, sf_dir):
    it = items(spark, sf_dir)
    q = vendor(spark, sf_dir).select(T.search_form("name").alias("norm"))
    found = blocking.candidate_names(q, blocking.classes(it))
    return found.groupBy("norm").agg(F.sum("n_items").alias("n_items"), F.min("first_item").alias("first_item"))


def search(spark, sf_dir):
    return ranking.search(vendor(spark, sf_dir), items(spark, sf_dir))


def search_twice(spark, sf_dir):
    return ranking.search_twice(vendor(spark, sf_dir), items(spark, sf_dir))


def browser_search(spark, sf_dir):
    found = ranking.browser_search(vendor(spark, sf_dir), items(spark, sf_dir))
    return found.withColumns({"rank": F.col("rank").cast("bigint"), "front": F.col("front").cast("bigint")})


def candidate_rules(spark, sf_dir):
    """Every rule of each profile on the candidates of each vendor row."""
    v, it = vendor(spark, sf_dir), items(spark, sf_dir)
    rows = written(cascade.candidate_rows(v, ranking.search(v, it)), "rows")
    out = None
    for p in rules.PROFILES.values():
        one = rules.judged(rows, p).select(F.lit(p.name).alias("profile"), "query_id", "rank", "code", "valid", "similar_brand", "doses_match", "form_match", "accepted", F.bround("score", 6).alias("score"))
        out = one if out is None else out.union(one)
    return out


def match_batch(spark, sf_dir):
    return cascade.run(vendor(spark, sf_dir), items(spark, sf_dir), cascade.BATCH)


def match_server(spark, sf_dir):
    return cascade.run(vendor(spark, sf_dir), items(spark, sf_dir), cascade.SERVER)


def match_old_server(spark, sf_dir):
    return cascade.run(vendor(spark, sf_dir), items(spark, sf_dir), cascade.OLD_SERVER)


def match_hybrid(spark, sf_dir):
    return cascade.run(vendor(spark, sf_dir), items(spark, sf_dir), cascade.HYBRID)


def match_browser(spark, sf_dir):
    return cascade.run_browser(vendor(spark, sf_dir), items(spark, sf_dir))


class NthReranker:
    """A stand-in for a model that other engines can follow: chooses by the length of the query, none for each seventh, and verifies queries of even length."""

    def choose(self, query, candidates, name, compname):
        return None if len(query) % 7 == 0 else 1 + len(query) % len(candidates)

    def verify(self, query, candidate, name, compname):
        return len(query) % 2 == 0


def match_reranked(spark, sf_dir):
    """The batch flow with a reranker that sees valid candidates."""
    return cascade.run(vendor(spark, sf_dir), items(spark, sf_dir), cascade.BATCH, NthReranker())


def match_verified(spark, sf_dir):
    """The old server's flow with a reranker that also verifies."""
    return cascade.run(vendor(spark, sf_dir), items(spark, sf_dir), cascade.OLD_SERVER, NthReranker())


def match_cached(spark, sf_dir):
    """The hybrid flow with its cache, which holds what every other query gave before."""
    v, it = vendor(spark, sf_dir), items(spark, sf_dir)
    store = cache.ResultCache(spark, new_folder(spark, "cache"))
    some = v.filter("query_id % 2 = 0")
    store.save(some, cascade.run(some, it, cascade.HYBRID))
    return cascade.run_cached(v, it, store)


def match_report(spark, sf_dir):
    v = vendor(spark, sf_dir)
    return report.report(v, cascade.run(v, items(spark, sf_dir), cascade.BATCH))


def report_summary(spark, sf_dir):
    return report.overview(match_report(spark, sf_dir))


def service_mappings(spark, sf_dir):
    v = vendor(spark, sf_dir)
    return report.mappings(v, cascade.run(v, items(spark, sf_dir), cascade.SERVER)).drop("source")


def unmatched_list(spark, sf_dir):
    """Unmatched queries with what a search for name and pack finds, a row per candidate."""
    v, it = vendor(spark, sf_dir), items(spark, sf_dir)
    found = report.unmatched(v, cascade.run(v, it, cascade.BATCH), it)
    return found.select("query_id", "name", "pack", F.explode_outer("candidates").alias("c")).select("query_id", "name", "pack", "c.*")


# --- sums over events ---



def timing_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("value").alias("search_ms"), (F.col("value") / 10).alias("heur_ms"), F.when(F.col("event_type") == "error", F.col("value") * 100).alias("llm_ms"))
    return report.timing(e)


def most_in_flight(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("start"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 60_000_000)).alias("end"))
    return report.most_in_flight(e).select(F.col("most_in_flight").cast("bigint").alias("most_in_flight"))


def progress_steps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("t"), (F.col("event_type") != "error").alias("matched"))
    return report.progress(e, 1_000_000, 86_400)


QUERIES = (
    match_batch, text_normalisers, text_tokenisers, strength_extraction, dose_numbers, pack_parser, companies, suffix_sets, forms, answers, chat_prompts, history_trimming, answer_pieces,
    similarity_ratios, partial_ratios, letter_pairs, abbreviations, alias_relation, catalog_cleaning, range_split, prefix_index, like_keys, candidate_counts, search, search_twice, browser_search,
    candidate_rules, match_server, match_old_server, match_hybrid, match_browser, match_report, report_summary, unmatched_list, match_reranked, match_verified, match_cached, service_mappings,
    csv_catalog, foreign_catalog, json_catalog, vendor_file, vendor_requests, merged_parts, cache_lookup, streamed_reports, timing_stats, most_in_flight, progress_steps,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}
