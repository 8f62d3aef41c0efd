"""Queries over the driver tables, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinfold.functions import similarity as sim
from kinfold.functions import text as tx
from kinfold.operators import decisions as de
from kinfold.operators import evaluation as ev
from kinfold.operators import folds as fo
from kinfold.operators import learning as le
from kinfold.operators import pairs as pa
from kinfold.operators import reports as rp
from kinfold.operators import retrieval as rt
from kinfold.plans import fixtures as fx
from kinfold.plans.fixtures import ENTITIES, NAMES, PAIRS, RECORDS, RETRIEVERS, STAR, read
from kinfold.sources import tables as tb
from kinfold.streaming import blocking as st

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# Text functions over whole documents.
_ONE = {k: v for k, v in tx.FOLD.items() if len(v) == 1 and ord(k) < 0x250 or k in "’‘“”–—"}
_SQL_CLEAN = f"lower(translate(coalesce(text, ''), '{''.join(_ONE)}', '{''.join(_ONE.values()).replace(chr(39), chr(39) * 2)}'))"
for _k, _v in tx.FOLD.items():
    if len(_v) > 1 and 0xC0 <= ord(_k) <= 0xFF:
        _SQL_CLEAN = f"replace({_SQL_CLEAN}, '{_k}', '{_v}')"
_NULLS = ", ".join(f"'{v}'" for v in tx.NULL_LIKE)
_CLEAN = f"""cleaned as (select doc_id, lang, case when trim(f, e' \\t\\n\\r') in ({_NULLS}) then ''
  else trim(regexp_replace(replace(f, '&', ' and '), '[^0-9a-z\\x{{0900}}-\\x{{0D7F}}]+', ' ', 'g')) end t from (select doc_id, lang, {_SQL_CLEAN} f from documents))"""


@query(f"with {_CLEAN} select doc_id, t from cleaned")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("t"))


_LEGAL = ", ".join(f"'{t}'" for t in tx.LEGAL)


@query(f"""with {_CLEAN}, k as (select doc_id, t, list_filter(string_split(t, ' '), lambda x: x not in ({_LEGAL})) w from cleaned)
select doc_id, case when len(w) > 0 then array_to_string(w, ' ') else t end legal,
  replace(regexp_replace(t, '^(?:www )|(?: (?:com|in|net|org|co|biz|info|fr|us))+$', '', 'g'), ' ', '') nospace,
  array_to_string(regexp_extract_all(t, '[0-9]+'), ' ') digits, 0::tinyint script from k""")
def name_views(spark: SparkSession, sf: str) -> DataFrame:
    t = tx.clean_text(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", tx.strip_legal(F.col("t")).alias("legal"), tx.no_space(F.col("t")).alias("nospace"), tx.digits_view(F.col("t")).alias("digits"), tx.script_code(F.col("t")).alias("script"))


@query("""select doc_id, length(text) - length(replace(text, chr(10), '')) n_lines, coalesce(string_split_regex(trim(text), '\\s+')[1], '') first,
  regexp_matches(text, '(?i)\\.(?:com|in|net|org|co)\\b') domain_like from documents""")
def text_probes(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    return d.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n_lines"), tx.first_word(F.col("text")).alias("first"), tx.domain_like(F.col("text")).alias("domain_like"))


@query()
def transliterate(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts, each behind one Indic sample word, romanised; letters of other scripts pass through."""
    return read(spark, sf, "documents").select("doc_id", tx.transliterate(F.concat(F.lit("विजन "), F.col("text"))).alias("latin"))


def _clean_sql(c: str) -> str:
    """``clean_text`` of an ASCII column."""
    return f"""case when trim(lower(coalesce({c}, '')), e' \\t\\n\\r') in ({_NULLS}) then '' else trim(regexp_replace(replace(lower(coalesce({c}, '')), '&', ' and '), '[^0-9a-z]+', ' ', 'g')) end"""


@query(f"""with v as (select c_custkey entity_id, c_name business_name, c_mktsegment business_address, {_clean_sql('c_name')} name_n, {_clean_sql('c_mktsegment')} addr_n from customer),
 k as (select *, list_filter(string_split(name_n, ' '), lambda x: x not in ({_LEGAL})) w from v)
select entity_id, business_name, business_address, name_n, addr_n, case when len(w) > 0 then array_to_string(w, ' ') else name_n end name_legal,
 replace(regexp_replace(name_n, '^(?:www )|(?: (?:com|in|net|org|co|biz|info|fr|us))+$', '', 'g'), ' ', '') name_nospace, array_to_string(regexp_extract_all(addr_n, '[0-9]+'), ' ') addr_digits,
 0::tinyint script, name_n name_tr, addr_n addr_tr from k""")
def normalized_views(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("business_name"), F.col("c_mktsegment").alias("business_address"))
    return tx.normalized(c)


# Pair similarities.
_TOK = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"


@query(f"""with {NAMES}, t as (select *, {_TOK.format('a')} x, {_TOK.format('b')} y from names)
select id, round(least(length(a), length(b))::double / greatest(length(a), length(b), 1), 6) len_ratio,
  round(len(list_distinct(list_intersect(x, y)))::double / greatest(len(list_distinct(list_concat(x, y))), 1), 6) jaccard,
  round(jaro_winkler_similarity(a, b), 6) jw from t""")
def name_similarity(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return fx.name_pairs(spark, sf).select("id", r6(sim.length_ratio(a, b)).alias("len_ratio"), r6(sim.token_jaccard(a, b)).alias("jaccard"), r6(sim.jaro_winkler_similarity(a, b)).alias("jw"))


_NUM = """nums as (select id, d, d[3:] e from (select doc_id id, regexp_extract_all(text, '[0-9]+') d from documents))"""


@query(f"""with {_NUM}, s as (select id, d, e, list_distinct(d) x, list_distinct(e) y from nums),
t as (select *, list_filter(x, lambda v: not list_contains(y, v)) l, list_filter(y, lambda v: not list_contains(x, v)) r from s)
select id, round(case when len(d) > 0 and len(e) > 0 then len(list_intersect(x, y))::double / len(list_distinct(list_concat(x, y))) else 0 end, 6) digit_jacc,
  case when len(d) = 0 or len(e) = 0 then 0 when d[1] = e[1] then 1 else -1 end house_state, len(d)::int n_digits_s1, len(e)::int n_digits_rec,
  len(l)::int num_only_s1, len(r)::int num_only_rec, least(len(l), len(r))::int num_conflict,
  case when len(l) > 0 and len(r) > 0 then least(list_max(list_transform(l, lambda v: length(v))), list_max(list_transform(r, lambda v: length(v)))) else 0 end::int num_conflict_len from t""")
def number_similarity(spark: SparkSession, sf: str) -> DataFrame:
    d = tx.digit_runs(F.col("text"))
    v = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_join(d, " ").alias("d"), F.array_join(F.slice(d, F.lit(3), F.size(d)), " ").alias("e"))
    f = sim.digit_features(F.col("d"), F.col("e")) | sim.number_features(F.col("d"), F.col("e"), F.lit(""), F.lit(""))
    f["digit_jacc"] = r6(f["digit_jacc"])
    return v.select("id", *[c.cast("int").alias(k) if k != "digit_jacc" else c.alias(k) for k, c in f.items() if not k.startswith("name_")])


@query()
def edit_ratios(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return fx.name_pairs(spark, sf).select("id", sim.indel_ratio(a, b).alias("ratio"), sim.token_set_ratio(a, b).alias("token_set"), sim.partial_ratio(a, b).alias("partial"))


# Retrieval.
def _docs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = F.lit("all").alias("part")
    return read(spark, sf, "documents").select(part, F.col("doc_id").alias("id"), F.lower("text").alias("text")), read(spark, sf, "benchmark").select(part, F.col("item_id").alias("id"), F.lower("text").alias("text"))


def _tfidf_sql(grams: str, max_df: float, k: int, min_df: int = 1) -> str:
    return f"""with u as (select 1 side, doc_id id, lower(text) text from documents union all select 0, item_id, lower(text) from benchmark),
 tok as (select side, id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') t from u),
 g as (select side, id, unnest({grams}) term from tok), tf as (select side, id, term, count(*) tf from g group by all),
 n as (select count(*) n from u), df as (select term, count(*) df from tf group by 1),
 w0 as (select side, id, term, (1 + ln(tf)) * (ln((n + 1)::double / (df + 1)) + 1) w from tf join df using (term), n where df <= {max_df} * n and df >= {min_df}),
 w as (select side, id, term, w / sqrt(sum(w * w) over (partition by side, id)) w from w0),
 s as (select a.id doc_id, b.id item_id, round(sum(a.w * b.w), 9) score from w a join w b using (term) where a.side = 1 and b.side = 0 group by 1, 2),
 r as (select *, row_number() over (partition by doc_id order by score desc, item_id) - 1 rank from s where score > 0)
 select doc_id, item_id, round(score, 6) score, rank::int rank from r where rank < {k}"""


_WORDS = "list_concat(t, list_transform(list_zip(t[1:len(t) - 1], t[2:len(t)]), lambda p: p[1] || ' ' || p[2]))"
_CHARS = "flatten(list_transform(t, lambda w: list_transform(range(1, greatest(length(w) + 2 - 3 + 1, 1) + 1), lambda i: substr(' ' || w || ' ', i, 3))))"


def _retrieved(spark: SparkSession, sf: str, **options) -> DataFrame:
    docs, items = _docs(spark, sf)
    return rt.record_side(docs, items, **options).select(F.col("q").alias("doc_id"), F.col("d").alias("item_id"), r6("score").alias("score"), "rank")


@query(_tfidf_sql(_WORDS, 0.01, 3))
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf, k=3, max_df=0.01)


@query(_tfidf_sql(_CHARS, 0.1, 5, 2))
def char3_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _retrieved(spark, sf, k=5, max_df=0.1, grams=rt.char_grams, min_df=2)


_DOT = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::double * p[2]::double)), 6)"


@query(f"""select q, d, score, rank::int rank from (select a.vec_id q, b.vec_id d, {_DOT} score, row_number() over (partition by a.vec_id order by {_DOT} desc, b.vec_id) - 1 rank
 from embeddings a, embeddings b where a.vec_id % 20 = 0) where rank < 10""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = rt.dense_top_k(v.where("id % 20 = 0"), v, 11)
    return rt.top_k(out.withColumn("score", r6("score")), 10, ["q"]).select("q", "d", "score", "rank")


def _rank_sql(tail: str) -> str:
    return f"""{STAR}, fwd as (select *, row_number() over (partition by country, src, s1 order by p desc, rec) - 1 rank from pairs),
 rev as (select *, row_number() over (partition by country, src, rec order by p desc, s1) - 1 rank from pairs) {tail}"""


@query(f"select a.vec_id q, b.vec_id d, {_DOT} cos from embeddings a join embeddings b on b.vec_id = (a.vec_id * 7 + 1) % (select count(*) from embeddings)")
def pair_cosine(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    n = v.agg(F.count(F.lit(1)).alias("n"))
    t = v.crossJoin(F.broadcast(n)).select(F.col("id").alias("q"), ((F.col("id") * 7 + 1) % F.col("n")).alias("d"))
    return rt.pair_cosine(t, v, v)


@query(f"""with s as (select a.vec_id q, b.vec_id d, {_DOT} cos from embeddings a, embeddings b where a.vec_id % 20 = 0),
 r as (select *, row_number() over (partition by q order by cos desc, d) - 1 x, row_number() over (partition by d order by cos desc, q) - 1 y from s)
select q, d, cos, case when x < 3 then x else -1 end::int drank_rec, case when y < 5 then y else -1 end::int drank_s1 from r where x < 3 or y < 5""")
def two_sided_dense(spark: SparkSession, sf: str) -> DataFrame:
    v = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    records, items = v.where("id % 20 = 0"), v
    near = rt.dense_top_k(records, items, 6).withColumn("score", r6("score"))
    back = rt.dense_top_k(items, records, 8).select(F.col("d").alias("q"), F.col("q").alias("d"), r6("score").alias("score"))
    return rt.two_sided(rt.top_k(near, 3, ["q"]), rt.top_k(back, 5, ["d"], tie="q"))


@query(_rank_sql(""", alt as (select *, row_number() over (partition by country, src, rec order by (rec * 31 + s1 * 17) % 1009 desc, s1) - 1 arank from pairs),
 g as (select a.country, avg((arank < 2)::int) dense, avg((r.rank < 2)::int) tfidf from alt a join rev r using (country, src, rec, s1) where a.label = 1 group by 1)
 select country, round(dense, 6) dense, round(tfidf, 6) tfidf, round(dense, 9) >= round(tfidf, 9) passed from g"""))
def recall_gate(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf).withColumn("alt", (F.col("rec") * 31 + F.col("s1") * 17) % 1009)
    a, b = (rt.top_k(t, 9, list(pa.REC), c, "s1").where("label = 1") for c in ("alt", "p"))
    return ev.recall_gate(a, b, 2).withColumns({c: r6(c) for c in ("dense", "tfidf")})


@query(_rank_sql("select 'fwd' way, country, src, s1, rec, rank::int rank from fwd where rank < 4 union all select 'rev', country, src, s1, rec, rank::int from rev where rank < 2"))
def forward_reverse_lists(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf)
    out = []
    for way, k, per, tie in (("fwd", 4, list(pa.ENT_SRC), "rec"), ("rev", 2, list(pa.REC), "s1")):
        out.append(rt.top_k(t, k, per, "p", tie).select(F.lit(way).alias("way"), "country", "src", "s1", "rec", "rank"))
    return out[0].unionByName(out[1])


_RANKS = """t as (select s1 q, rec d, country from pairs where label = 1), lists as (select s1 q, rec d, rank from fwd where rank < 2 and s1 % 3 > 0), asked as (select s1 q from entities where s1 % 3 > 0),
 ranked as (select t.q, t.d, t.country, case when asked.q is null then -2 else coalesce(rank, -1) end::int rank from t left join lists using (q, d) left join asked on asked.q = t.q)"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf)
    lists = rt.top_k(t.where("s1 % 3 > 0"), 2, list(pa.ENT_SRC), "p", "rec").select(F.col("s1").alias("q"), F.col("rec").alias("d"), "rank")
    wanted = t.where("label = 1").select(F.col("s1").alias("q"), F.col("rec").alias("d"), "country")
    return rt.rank_of(wanted, lists, fx.entities(spark, sf).where("s1 % 3 > 0").select(F.col("s1").alias("q"))).select("q", "d", "country", "rank")


@query(_rank_sql(f", {_RANKS} select * from ranked"))
def rank_table(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


@query(_rank_sql(f", {_RANKS} select country, count(*) n, round(avg((rank = 0)::int), 6) r_at_1, round(avg((rank between 0 and 4)::int), 6) r_at_5 from ranked group by cube (country)"))
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    out = rt.recall_at(_ranked(spark, sf), (1, 5), "country")
    return out.select("country", "n", r6("r_at_1").alias("r_at_1"), r6("r_at_5").alias("r_at_5"))


# Pairs and windows.
@query(f"with {RECORDS} select src, count(*) n, round(avg((parent < 0)::int), 6) orphan_share from records group by 1")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return rp.orphan_shares(fx.records(spark, sf)).select("src", "n", r6("orphan_share").alias("orphan_share"))


@query(f"with {RECORDS} select country, src, rec, parent from records")
def truth_parents(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.records(spark, sf)
    return pa.with_parents(r.drop("parent"), r.where("parent >= 0").select("rec", F.col("parent").alias("s1"))).select("country", "src", "rec", "parent")


@query(f"""{STAR} select country, src, rec, s1, round(max(p) over r - p, 6) gap_rec, count(*) over r n_cand_rec, (row_number() over (partition by country, src, s1 order by p desc, rec) - 1)::int rank_s1,
 round(max(p) over e - p, 6) gap_s1, count(*) over e n_cand_s1_src, count(*) over (partition by country, s1) n_cand_s1
 from pairs window r as (partition by country, src, rec), e as (partition by country, src, s1)""")
def retrieval_features(spark: SparkSession, sf: str) -> DataFrame:
    out = pa.retrieval_windows(fx.pairs(spark, sf), "p")
    return out.select("country", "src", "rec", "s1", r6("gap_rec").alias("gap_rec"), "n_cand_rec", "rank_s1", r6("gap_s1").alias("gap_s1"), "n_cand_s1_src", "n_cand_s1")


@query(f"""{STAR}, {RETRIEVERS}, m as (select coalesce(tf.country, de.country) country, coalesce(tf.src, de.src) src, coalesce(tf.rec, de.rec) rec, coalesce(tf.s1, de.s1) s1, score, rank, tf.cos c1, de.cos c2, drank_rec, drank_s1
  from tf full join de on tf.country = de.country and tf.src = de.src and tf.rec = de.rec and tf.s1 = de.s1),
u as (select country, src, rec, s1, round(coalesce(score, 0), 6) score, coalesce(rank, 6) rank, (score is not null)::int in_tfidf, coalesce(c1, c2) cos,
  (coalesce(drank_rec, -1) >= 0 or coalesce(drank_s1, -1) >= 0)::int in_dense, case when coalesce(drank_rec, -1) >= 0 then drank_rec else 6 end drank_rec,
  case when coalesce(drank_s1, -1) >= 0 then drank_s1 else 6 end drank_s1, (score is not null)::int + (coalesce(drank_rec, -1) >= 0)::int + (coalesce(drank_s1, -1) >= 0)::int n_retrievers from m)
select *, round(max(cos) over (partition by country, src, rec) - cos, 6) dgap_rec, (row_number() over (partition by country, src, rec order by cos desc, s1) - 1)::int drank_rec_all,
  round(max(cos) over (partition by country, src, s1) - cos, 6) dgap_s1, (row_number() over (partition by country, src, s1 order by cos desc, rec) - 1)::int drank_s1_all from u""")
def union_candidates(spark: SparkSession, sf: str) -> DataFrame:
    out = pa.dense_windows(pa.union_candidates(*fx.dense_pairs(spark, sf)))
    return out.withColumns({c: r6(c) for c in ("score", "dgap_rec", "dgap_s1")})


@query(f"""{STAR}, r as (select *, (country << 40) | (src << 32) | rec record_key, (country << 32) | s1 entity_key, (src << 43) | (rec << 21) | s1 pair_key from pairs)
select country, src, rec, s1, record_key, entity_key, pair_key from r""")
def packed_keys(spark: SparkSession, sf: str) -> DataFrame:
    return fx.pairs(spark, sf).select("country", "src", "rec", "s1", pa.packed_key("record").alias("record_key"), pa.packed_key("entity").alias("entity_key"), pa.packed_key("pair").alias("pair_key"))


_G = """select *, row_number() over (partition by country, src, rec order by p desc, s1) - 1 rr, row_number() over (partition by country, src, s1 order by p desc, rec) - 1 er,
  max(p) over (partition by country, src, rec) rm, max(p) over (partition by country, src, s1) em from pairs"""


@query(f"""{STAR}, g as ({_G}), h as (select *, coalesce(max(case when rr = 1 then p end) over (partition by country, src, rec), 0) r2, coalesce(max(case when er = 1 then p end) over (partition by country, src, s1), 0) e2 from g)
select country, src, rec, s1, round(p, 6) p, label, round(rm, 6) rec_pmax, round(r2, 6) rec_p2, round(case when rr = 0 then p - r2 else p - rm end, 6) p_minus_rec_other, rr::int rec_prank,
 count(*) over (partition by country, src, rec) rec_n, round(em, 6) s1src_pmax, er::int s1src_prank, (sum((p > 0.5)::int) over (partition by country, src, s1))::bigint s1src_n05,
 round(sum(p) over (partition by country, src, s1), 6) s1src_psum, round(case when er = 0 then p - e2 else p - em end, 6) p_minus_s1src_other,
 (sum((p > 0.5)::int) over (partition by country, s1))::bigint s1_n05, round(coalesce(case when src = 2 then max(case when src = 3 then p end) over (partition by country, s1) else max(case when src = 2 then p end) over (partition by country, s1) end, 0), 6) s1_pmax_other_src,
 (sum((rr = 0)::int) over (partition by country, s1))::bigint s1_n_best from h""")
def stage2_features(spark: SparkSession, sf: str) -> DataFrame:
    out = pa.competition_features(fx.pairs(spark, sf))
    return out.withColumns({c: r6(c) for c in ("p", "rec_pmax", "rec_p2", "p_minus_rec_other", "s1src_pmax", "s1src_psum", "p_minus_s1src_other", "s1_pmax_other_src")})


@query(f"""{STAR}, c as (select *, case when p between 0.2 and 0.9 then p * 4 - 2 end ce from pairs),
 s as (select *, row_number() over (partition by country, src, rec order by ce desc, s1) rn, count(*) over (partition by country, src, rec) n, max(ce) over (partition by country, src, rec) m from c where ce is not null),
 t as (select *, max(case when rn = 2 then ce end) over (partition by country, src, rec) m2 from s)
select c.country, c.src, c.rec, c.s1, round(c.ce, 6) ce, round(case when n > 1 then c.ce - case when rn = 1 then m2 else m end end, 6) ce_minus_rec_other from c left join t using (country, src, rec, s1)""")
def ce_margin(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.pairs(spark, sf).withColumn("ce", F.when(F.col("p").between(0.2, 0.9), F.col("p") * 4 - 2))
    return pa.scored_margin(c).select("country", "src", "rec", "s1", r6("ce").alias("ce"), r6("ce_minus_rec_other").alias("ce_minus_rec_other"))


@query(f"""{STAR}, {RETRIEVERS} select rec, s1 from tf anti join de using (country, src, rec, s1)""")
def subset_violations(spark: SparkSession, sf: str) -> DataFrame:
    a, b = fx.dense_pairs(spark, sf)
    return pa.not_subset(a.select("s1", F.col("rec").alias("rid")), b.select("s1", F.col("rec").alias("rid"))).select(F.col("rid").alias("rec"), "s1")


# Decisions.
_ARB = """won as (select *, row_number() over (partition by country, src, rec order by p desc, s1) = 1 winner from pairs),
 arb as (select *, case when winner then row_number() over (partition by country, s1, winner order by p desc, src, rec) - 1 else -1 end::int pos, case when winner then max(p) over (partition by country, s1, winner) else 0 end top_p from won)"""


@query(f"{STAR}, {_ARB} select country, src, rec, s1, winner, pos, round(top_p, 6) top_p from arb")
def arbitration(spark: SparkSession, sf: str) -> DataFrame:
    return de.arbitrated(fx.pairs(spark, sf)).select("country", "src", "rec", "s1", "winner", "pos", r6("top_p").alias("top_p"))


_KEEP = "winner and ((pos = 0 and p >= 0.6) or (pos > 0 and p >= 0.75 and top_p >= 0.6))"


@query(f"{STAR}, {_ARB} select country, src, rec, s1, {_KEEP} keep, p >= 0.6 keep_plain from arb")
def threshold_rule(spark: SparkSession, sf: str) -> DataFrame:
    t = de.arbitrated(fx.pairs(spark, sf))
    return t.select("country", "src", "rec", "s1", de.threshold_rule(0.6, 0.75).alias("keep"), de.threshold_rule(0.6, 0.75, False).alias("keep_plain"))


_F = "case when k = 0 then (m = 0)::int::double when tp > 0 then 1.25 * (tp::double / greatest(m, 1)) * (tp::double / greatest(k, 1)) / (0.25 * (tp::double / greatest(m, 1)) + (tp::double / greatest(k, 1))) else 0 end"
_GRID = "(select round(0.1 + 0.05 * i, 3) t from range(18) r(i))"


@query(f"""{STAR}, {_ARB}, w as (select * from arb where winner), g as (select a.t t_first, b.t t_rest from {_GRID} a, {_GRID} b),
 c as (select country, s1, t_first, t_rest, count(*) m, sum(label) tp from w, g where (pos = 0 and p >= t_first) or (pos > 0 and p >= t_rest and top_p >= t_first) group by all),
 e as (select t_first, t_rest, k, coalesce(m, 0) m, coalesce(tp, 0) tp from entities cross join g left join c using (country, s1, t_first, t_rest))
select t_first::double t_first, t_rest::double t_rest, round(avg({_F}), 6) f05 from e group by 1, 2""")
def grid_tune(spark: SparkSession, sf: str) -> DataFrame:
    out = de.tuned(de.arbitrated(fx.pairs(spark, sf)), fx.entities(spark, sf), de.grid())
    return out.select("t_first", "t_rest", r6("f05").alias("f05"))


@query(f"""{STAR}, {_ARB}, q as (select *, least(greatest(p, 1e-6), 1 - 1e-6) q from arb where winner),
 a as (select *, row_number() over o - 1 i, sum(q) over (o rows unbounded preceding) cs, sum(q) over e ek, exp(sum(ln(1 - q)) over e) none from q window o as (partition by country, s1 order by q desc, src, rec), e as (partition by country, s1)),
 s as (select *, 1.25 * cs / (0.25 * ek + i + 1) sc from a), b as (select *, max(sc) over (partition by country, s1) best from s),
 c as (select *, min(case when sc >= best - 1e-12 then i end) over (partition by country, s1) mi from b)
select country, src, rec, s1, none < best and i <= mi keep from c union all select country, src, rec, s1, false from arb where not winner""")
def expected_f_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return de.expected_f(de.arbitrated(fx.pairs(spark, sf))).select("country", "src", "rec", "s1", "keep")


@query(f"""{STAR}, t as (select unnest([0.0, 0.1, 0.3, 0.5, 0.7, 0.9])::double tau), c as (select country, s1, tau, count(*) m, sum(label) tp from pairs, t where p >= tau group by all),
 e as (select tau, k, coalesce(m, 0) m0, coalesce(tp, 0) tp, coalesce(tp, 0) m from entities cross join t left join c using (country, s1, tau))
select tau, round(avg(m0), 6) cand_per_s1, round(avg({_F}), 6) oracle_f05 from e group by 1""")
def prune_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = de.prune_curve(fx.pairs(spark, sf), fx.entities(spark, sf), [0.0, 0.1, 0.3, 0.5, 0.7, 0.9])
    return out.select("tau", r6("cand_per_s1").alias("cand_per_s1"), r6("oracle_f05").alias("oracle_f05"))


@query(f"""{STAR}, {_ARB} select country, src, rec, s1, round(d, 6) d from (select *, abs(p - case when pos = 0 then 0.7 else 0.5 end) d from arb where winner) order by d, country, src, rec, s1 limit 200""")
def decision_band(spark: SparkSession, sf: str) -> DataFrame:
    t = de.arbitrated(fx.pairs(spark, sf)).withColumn("d", de.decision_distance(0.7, 0.5))
    return de.nearest(t, 200).select("country", "src", "rec", "s1", r6("d").alias("d"))


# Evaluation.
def _truth(spark, sf):
    return fx.records(spark, sf).where("parent >= 0").select(F.col("parent").alias("s1"), F.col("rec").alias("rid"))


def _pred(spark, sf):
    return fx.pairs(spark, sf).where("p >= 0.5").select("s1", F.col("rec").alias("rid"))


_SC = f"""sc as (select s1, country, k, coalesce(m, 0)::bigint m, coalesce(tp, 0)::bigint tp from entities left join (select s1, count(*) m, sum(label) tp from pairs where p >= 0.5 group by 1) using (s1)),
 scores as (select *, least(k, 6) k_bucket, {_F} f05 from sc)"""


@query(f"{STAR}, {_SC} select s1, k, m, tp, round(f05, 6) f05 from scores")
def f05_per_entity(spark: SparkSession, sf: str) -> DataFrame:
    return ev.per_entity(_truth(spark, sf), _pred(spark, sf), fx.entities(spark, sf)).withColumn("f05", r6("f05"))


@query(f"{STAR}, {_SC} select round(avg(f05), 6) f05, count(*) n from scores")
def macro_f05(spark: SparkSession, sf: str) -> DataFrame:
    return ev.macro(ev.per_entity(_truth(spark, sf), _pred(spark, sf), fx.entities(spark, sf))).select(r6("f05").alias("f05"), "n")


@query(f"{STAR}, {_SC}, o as (select s1, k, tp m, tp from sc) select s1, k, m, tp, round({_F}, 6) f05 from o")
def oracle_f05(spark: SparkSession, sf: str) -> DataFrame:
    return ev.oracle(_truth(spark, sf), _pred(spark, sf), fx.entities(spark, sf)).withColumn("f05", r6("f05"))


@query(f"""{STAR}, {_SC} select case when grouping(country) = 0 then 'country=' || country when grouping(k_bucket) = 0 then 'k_bucket=' || k_bucket else 'ALL' end stratum,
 count(*) n, round(count(*)::double / (select count(*) from scores), 6) share, round(avg(f05), 6) f05 from scores group by grouping sets ((), (country), (k_bucket))""")
def strata_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.per_entity(_truth(spark, sf), _pred(spark, sf), fx.entities(spark, sf)).withColumns({"country": F.col("s1") % 5, "k_bucket": ev.k_bucket(F.col("k"))})
    return ev.strata(s, ("country", "k_bucket")).select("stratum", "n", r6("share").alias("share"), r6("f05").alias("f05"))


@query(f"""{STAR}, {_ARB}, kept as (select * from arb where {_KEEP}), e as (select e.s1, e.k, coalesce(kk.m, 0) m, coalesce(kk.tp, 0) tp, coalesce(r.reach, 0) reach from entities e
  left join (select s1, count(*) m, sum(label) tp from kept group by 1) kk using (s1) left join (select s1, sum(label) reach from pairs group by 1) r using (s1)),
 f as (select least(k, 6) bucket, {_F} actual, {_F.replace('m,', 'tp,').replace('(m ', '(tp ')} clean, {_F.replace('tp', 'reach').replace('m,', 'reach,').replace('(m ', '(reach ')} best from e)
select bucket, count(*) n, round(avg(clean - actual), 6) wrong, round(avg(best - clean), 6) rejected, round(avg(1 - best), 6) missed from f group by cube (bucket)""")
def loss_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf)
    kept = de.arbitrated(t).where(de.threshold_rule(0.6, 0.75))
    out = ev.loss_split(fx.entities(spark, sf), kept.select("s1", "label"), t.select("s1", "label"))
    return out.select("bucket", "n", *[r6(c).alias(c) for c in ("wrong", "rejected", "missed")])


@query(f"""{STAR}, {_ARB}, wrong as (select a.rec, r.parent, a.rec in (select rec from pairs where label = 1) found from arb a join records r using (rec) where {_KEEP} and label = 0),
 c as (select case when parent < 0 then 'orphan' when found then 'parent_retrieved' else 'parent_missing' end kind, count(*) n from wrong group by 1)
select kind, n, round(n::double / (select sum(n) from c), 6) share from c""")
def error_anatomy(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf)
    kept = de.arbitrated(t).where(de.threshold_rule(0.6, 0.75))
    return ev.error_anatomy(kept.select("rec", "label"), fx.records(spark, sf).select("rec", "parent"), t.select("rec", "label")).withColumn("share", r6("share"))


@query(_rank_sql(f""", h as (select s1, least(frank, rrank) >= 0 and (frank < 2 or rrank < 1) hit, (src = 3)::int script, (rec % 7)::double / 7 name_jacc from (select f.s1, f.src, f.rec, f.rank frank, r.rank rrank, f.label from fwd f join rev r using (country, src, rec, s1)) where label = 1),
 c as (select s1, count(*) c from (select distinct s1, src, rec from fwd where rank < 2 union select distinct s1, src, rec from rev where rank < 1) group by 1),
 e as (select e.s1, coalesce(p.k, 0) k, coalesce(p.tp, 0) tp, coalesce(p.tp, 0) m, coalesce(c, 0) c from entities e left join (select s1, count(*) k, sum(hit::int) tp from h group by 1) p using (s1) left join c using (s1))
 select * from (select round(avg({_F}), 6) oracle_f05, round(avg(c), 6) c_mean, floor(quantile_cont(c, 0.9))::bigint c_p90, max(c) c_max from e),
 (select round(avg(hit::int), 6) pair_recall, round(avg(hit::int) filter (script > 0), 6) recall_other_script, round(avg(hit::int) filter (name_jacc < 0.25), 6) recall_low_name from h)"""))
def audit_config(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf)
    ways = (("NA_fwd", list(pa.ENT_SRC), "rec"), ("NA_rev", list(pa.REC), "s1"))
    both = t.withColumns({name: F.row_number().over(W.partitionBy(*per).orderBy(F.desc("p"), tie)) - 1 for name, per, tie in ways})
    config = ev.parse_config("NA:f2,NA:r1")
    ranks = both.where("label = 1").select("s1", "NA_fwd", "NA_rev", (F.col("src") == 3).cast("int").alias("script"), (F.col("rec") % 7 / 7.0).alias("name_jacc"))
    out = ev.audit(ranks, fx.entities(spark, sf), both.where(ev.reachable(config)), config)
    return out.withColumns({c: r6(c) for c in ("oracle_f05", "c_mean", "pair_recall", "recall_other_script", "recall_low_name")})


# Folds and samples.
_FOLDS = """dealt as (select *, least(k, 6) k_bucket, (row_number() over (partition by country, least(k, 6) order by (s1 * 7919) % 1000003, s1) - 1) % 5 f from entities)"""


@query(f"with {RECORDS}, {ENTITIES}, {_FOLDS} select country, s1, k, k_bucket, f::int fold from dealt")
def assign_folds(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entities(spark, sf).drop("fold", "name")
    return fo.assign_folds(e, order=F.col("s1") * 7919 % 1000003).select("country", "s1", "k", "k_bucket", "fold")


@query(f"with {RECORDS}, {ENTITIES}, {_FOLDS} select country, k_bucket, " + ", ".join(f'count(*) filter (f = {i}) "{i}"' for i in range(5)) + " from dealt group by 1, 2")
def fold_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return fo.fold_crosstab(assign_folds(spark, sf))


_M = "18446744073709551616::hugeint"


def _mul(x: str, c: int) -> str:
    """x * c mod 2**64 in pieces that fit 128 bits."""
    return f"((({x}) * {c & 0xFFFFFFFF}::hugeint + ((({x}) * {c >> 32}::hugeint) % 4294967296::hugeint) * 4294967296::hugeint) % {_M})"


@query(f"""with a as (select c_custkey s1, xor({_mul('c_custkey::hugeint', 0x9E3779B97F4A7C15)}::uhugeint, {_mul('11::hugeint', 0xBF58476D1CE4E5B9)}::uhugeint)::hugeint x from customer),
 b as (select s1, {_mul('xor(x::uhugeint, (x // 1073741824)::uhugeint)::hugeint', 0xBF58476D1CE4E5B9)} x from a),
 c as (select s1, {_mul('xor(x::uhugeint, (x // 134217728)::uhugeint)::hugeint', 0x94D049BB133111EB)} x from b),
 d as (select s1, xor(x::uhugeint, (x // 2147483648)::uhugeint)::hugeint x from c)
select s1, round((x // 2048)::double / 9007199254740992::double, 9) u from d""")
def entity_uniform(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("s1"), F.round(fo.entity_uniform(F.col("c_custkey"), 11), 9).alias("u"))


@query(f"""with {NAMES}, t as (select id, list_distinct(regexp_extract_all(a, '\\w+')) x, list_distinct(regexp_extract_all(b, '\\w+')) y from names)
select id, round(len(list_intersect(x, y))::double / greatest(len(list_distinct(list_concat(x, y))), 1), 6) jaccard from t""")
def word_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return fx.name_pairs(spark, sf).select("id", r6(sim.jaccard(tx.word_tokens(F.col("a")), tx.word_tokens(F.col("b")))).alias("jaccard"))


@query(ORACLES["entity_uniform"].replace("select s1, round(", "select s1 from (select s1, round(").replace(" u from d", " u from d) where u < 0.3"))
def entity_sample(spark: SparkSession, sf: str) -> DataFrame:
    return fo.sampled(read(spark, sf, "customer").select(F.col("c_custkey").alias("s1")), 0.3, "s1", 11)


@query(f"""with {RECORDS}, {ENTITIES}, c as (select parent s1, count(*) n from records where parent >= 0 group by 1), o as (select s1, sum(n) over (order by (s1 * 7919) % 1000003, s1) run from c)
select parent s1, rec from records where parent in (select s1 from o where run <= (select count(*) // 4 from records))""")
def budget_sample(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.records(spark, sf)
    t = r.where("parent >= 0").select(F.col("parent").alias("s1"), "rec")
    return fo.within_budget(t, "s1", r.count() // 4, F.col("s1") * 7919 % 1000003)


@query("""select time_bucket(interval 1 day, ts) as \"day\", event_type, count(*) n from events group by 1, 2""")
def windowed_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    return st.windowed_arrivals(read(spark, sf, "events")).select(F.col("window.start").alias("day"), "event_type", "n")


@query()
def bootstrap_delta(spark: SparkSession, sf: str) -> DataFrame:
    s = ev.per_entity(_truth(spark, sf), _pred(spark, sf), fx.entities(spark, sf))
    b = ev.paired_bootstrap(s.select(F.col("s1").alias("key"), (F.col("f05") - 0.2).alias("d")), 200)
    return spark.createDataFrame([(b["delta"], b["ci_low"], b["ci_high"], b["significant"], b["n_entities"], ev.verdict(b))], "delta double, ci_low double, ci_high double, significant boolean, n long, verdict string")


@query("select item_id, length(text)::int n from benchmark order by n, item_id")
def length_order(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items by length, ties by id."""
    return read(spark, sf, "benchmark").select("item_id", F.length("text").alias("n")).orderBy("n", "item_id")


@query(f"""with {RECORDS}, {ENTITIES}, a as (select *, fold in (3, 4) and name <> '' ok from entities),
 n as (select s1, ok, count(*) over w c, coalesce(lead(s1) over (w order by s1), first(s1) over (w order by s1)) nx from a window w as (partition by name, ok))
select s1, case when ok and c > 1 then nx else -1 end sibling from n""")
def sibling_cyclic(spark: SparkSession, sf: str) -> DataFrame:
    return fo.next_sibling(fx.entities(spark, sf), "name", "s1", F.col("fold").isin(3, 4)).select("s1", "sibling")


@query(f"""{STAR}, r as (select *, row_number() over (partition by country, src, rec order by p desc, s1) - 1 rank from pairs),
 h as (select *, row_number() over (partition by country, src, rec order by rank, s1) rn from r where label = 0) select country, src, rec, s1 neg_s1 from h where rn = 1""")
def hard_negative(spark: SparkSession, sf: str) -> DataFrame:
    return fo.hard_negatives(rt.top_k(fx.pairs(spark, sf), 99, list(pa.REC), "p", "s1"))


@query()
def training_triplets(spark: SparkSession, sf: str) -> DataFrame:
    ranked = rt.top_k(fx.pairs(spark, sf), 99, list(pa.REC), "p", "s1")
    return fo.training_triplets(fx.records(spark, sf).drop("cust"), ranked, fx.entities(spark, sf), [3, 4])


_DRAWN = ORACLES["entity_uniform"].replace("c_custkey", "o_orderkey").replace("from customer", "from orders")


@query(f"""with {RECORDS}, {ENTITIES}, drawn as ({_DRAWN}) select r.country, src, rec, parent, coalesce(fold, least(floor(u * 5), 4))::int owner
 from records r left join entities e on e.country = r.country and e.s1 = parent join drawn on drawn.s1 = rec""")
def owner_fold(spark: SparkSession, sf: str) -> DataFrame:
    return fo.owner_fold(fx.records(spark, sf), fx.entities(spark, sf)).select("country", "src", "rec", "parent", "owner")


_BATCH = """b as (select country, src, rec, s1, n // 64 batch from (select *, row_number() over (partition by country order by (rec * 31) % 1009, src, rec) - 1 n, count(*) over (partition by country) c from pairs where label = 1) where (n // 64 + 1) * 64 <= c)"""


@query(f"{STAR}, {_BATCH} select country, src, rec, s1, batch from b")
def batches(spark: SparkSession, sf: str) -> DataFrame:
    return fo.batches(fx.pairs(spark, sf).where("label = 1"), 64, order=F.col("rec") * 31 % 1009).select("country", "src", "rec", "s1", "batch")


@query(f"""{STAR}, {_BATCH}, r as (select country * 100000 + batch batch, row_number() over (partition by country, batch order by src, rec) - 1 row, s1 pos_s1, (s1 + 5) % 50 neg_s1 from b),
 n as (select batch, count(*) n from r group by 1), cols as (select batch, row col, pos_s1 s from r union all select batch, row + n, neg_s1 from r join n using (batch))
select batch, row::int row, col::bigint col, s = pos_s1 false_negative, s % 10 = pos_s1 % 10 duplicate_text from r join cols using (batch) where row <> col and (s = pos_s1 or s % 10 = pos_s1 % 10)""")
def batch_masks(spark: SparkSession, sf: str) -> DataFrame:
    b = batches(spark, sf).withColumn("batch", F.col("country") * 100000 + F.col("batch"))
    t = b.select("batch", "src", "rec", F.col("s1").alias("pos_s1"), ((F.col("s1") + 5) % 50).alias("neg_s1")).withColumns({"pos_text": F.col("pos_s1") % 10, "neg_text": F.col("neg_s1") % 10})
    return fo.masks(t).withColumn("col", F.col("col").cast("long"))


# Learning.
def _classified(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    t, features = F.col("text"), ["chars", "words", "upper", "signs", "numbers", "lines"]
    n = F.greatest(F.length(t), F.lit(1))
    f = [F.length(t), F.size(F.split(t, r"\s+")), F.regexp_count(t, F.lit("[A-Z]")) / n, F.regexp_count(t, F.lit("[^\\w\\s]")) / n, F.regexp_count(t, F.lit("[0-9]")) / n, F.regexp_count(t, F.lit("\n"))]
    return d.select(F.col("doc_id").alias("s1"), (F.col("doc_id") % 3).cast("int").alias("fold"), F.col("quality").alias("label"), *[c.cast("double").alias(k) for k, c in zip(features, f, strict=True)]), features


@query()
def cross_fit_oof(spark: SparkSession, sf: str) -> DataFrame:
    d, features = _classified(spark, sf)
    d = d.cache()
    return le.cross_predict(le.cross_fit(d, features, [0, 1, 2], kind="forest"), d, features).select("s1", "fold", "label", "p")


@query()
def isotonic(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf)
    return le.calibrated(t.where("s1 % 2 = 0"), t).select("country", "src", "rec", "s1", "q")


@query()
def combiner(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf).withColumn("s", F.when(F.col("rec") % 2 == 0, (F.col("label") * 6 + F.col("rec") % 5) / 10.0))
    return le.combined(t, t).select("country", "src", "rec", "s1", "p_new")


# Sinks and reports.
@query(f"""{STAR} select s1, coalesce(string_agg('S' || src || '-' || rec, ',' order by 'S' || src || '-' || rec) filter (p >= 0.5), '') matches, coalesce(string_agg('S' || src || '-' || rec, ',' order by 'S' || src || '-' || rec), '') candidates
 from entities left join pairs using (country, s1) group by 1""")
def id_lists(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf).select("s1", F.concat(F.lit("S"), F.col("src"), F.lit("-"), F.col("rec")).alias("rid"), (F.col("p") >= 0.5).alias("keep"))
    return tb.both_lists(t, fx.entities(spark, sf))


@query(f"""{STAR}, l as (select s1, string_agg(rec::varchar, ',' order by rec::varchar) ids from pairs where p >= 0.5 group by 1) select s1, unnest(string_split(ids, ',')) rid from l""")
def truth_explode(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf).where("p >= 0.5").select("s1", F.col("rec").cast("string").alias("rid"))
    return tb.truth_pairs(tb.id_lists(t, fx.entities(spark, sf)), "s1", "ids")


@query(f"""{STAR}, lines as (select s1, rec, 'S' || (case when rec % 50 = 0 then 1 else src end) || '-' || rec rid from pairs where p >= 0.5 and s1 % 10 > 0)
select * from (select 'missing_entity' rule, count(*) n from entities where s1 not in (select s1 from lines) union all select 'self_match', count(*) from lines where rid like 'S1-%') where n > 0""")
def validator_report(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.pairs(spark, sf).where("p >= 0.5 and s1 % 10 > 0")
    rid = F.concat(F.lit("S"), F.when(F.col("rec") % 50 == 0, 1).otherwise(F.col("src")), F.lit("-"), F.col("rec"))
    rows = tb.id_lists(t.select("s1", rid.alias("rid")), t.select("s1"))
    head = spark.createDataFrame([(f"{tb.TRUTH[0]}\tmatched_entity_ids",)], "line string")
    lines = rows.select(F.concat_ws("\t", "s1", "ids").alias("line")).unionByName(head)
    parts = F.split("line", "\t", 2)
    lines = lines.select("line", parts[0].alias("s1"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("ids"), (F.size(parts) == 2).alias("has_tab"))
    return tb.check_lists(lines, "matched_entity_ids", fx.entities(spark, sf).select(F.col("s1").cast("string"))).select("rule", "n")


@query(f"""{STAR}, {_ARB}, e as (select country, count(*) entities from entities group by 1), p as (select country, s1, count(*) c, sum(({_KEEP})::int) m from arb group by 1, 2),
 c as (select country, sum(c) c, sum(m) m, sum((m > 0)::int) s from p group by 1), b as (select country, src, rec, max(p) b from arb group by 1, 2, 3),
 q as (select country, quantile_cont(b, 0.1) a1, quantile_cont(b, 0.5) a2, quantile_cont(b, 0.9) a3, avg((b >= 0.5)::int) h from b group by 1)
select country, entities, round(c / entities, 6) candidates_per_s1, round(m / entities, 6) predicted_per_s1, round(1 - s / entities, 6) share_empty, round(a1, 6) best_p_q10, round(a2, 6) best_p_q50, round(a3, 6) best_p_q90, round(h, 6) share_best_p_half
 from e join c using (country) join q using (country)""")
def country_profile(spark: SparkSession, sf: str) -> DataFrame:
    t = de.arbitrated(fx.pairs(spark, sf)).withColumn("keep", de.threshold_rule(0.6, 0.75))
    out = rp.country_profile(fx.entities(spark, sf), t)
    return out.select("country", "entities", *[r6(c).alias(c) for c in out.columns[2:]])


@query(f"""{STAR.replace('pairs as (', 'pairs0 as (')}, pairs as (select * from pairs0 where s1 % 5 <> 3 or s1 % 2 = 1), ents as (select * from entities where s1 % 5 <> 3 or s1 % 2 = 1), {_ARB},
 x as (select s1, count(*) m, sum(label) tp from arb where {_KEEP} group by 1), e as (select k, coalesce(m, 0) m, coalesce(tp, 0) tp from ents left join x using (s1)) select round(avg({_F}), 6) f05, count(*) n from e""")
def density_stress(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entities(spark, sf)
    gone = e.where("s1 % 5 = 3 and s1 % 2 = 0")
    t = de.arbitrated(rp.without(fx.pairs(spark, sf), gone)).where(de.threshold_rule(0.6, 0.75))
    left = e.join(gone.select("s1"), "s1", "left_anti")
    per = left.join(t.groupBy("s1").agg(F.count(F.lit(1)).alias("m"), F.sum("label").alias("tp")), "s1", "left").fillna(0)
    return per.agg(r6(F.avg(de.f_half(F.col("k"), F.col("m"), F.col("tp")))).alias("f05"), F.count(F.lit(1)).alias("n"))


@query(f"with {RECORDS}, {ENTITIES} select k, count(*) n from entities group by 1")
def match_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rp.match_histogram(fx.entities(spark, sf))


@query(f"with {RECORDS}, {ENTITIES} select country, entities, records, round(records / entities, 6) density from (select country, count(*) entities from entities group by 1) join (select country, count(*) records from records group by 1) using (country)")
def density(spark: SparkSession, sf: str) -> DataFrame:
    return rp.density(fx.entities(spark, sf), fx.records(spark, sf)).withColumn("density", r6("density"))


@query(f"with {RECORDS} select round(corr(rec, parent), 6) corr from records where parent >= 0")
def position_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rp.position_correlation(fx.records(spark, sf).where("parent >= 0"), "rec", "parent").select(r6("corr").alias("corr"))


@query(f"""{STAR}, l as (select country, s1, coalesce(string_agg(rec::varchar, ',' order by rec::varchar), '') ids from entities left join (select * from pairs where p >= 0.5) using (country, s1) group by 1, 2) select s1, case when country = 2 then '' else ids end ids from l""")
def probe_lists(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.entities(spark, sf)
    t = fx.pairs(spark, sf).where("p >= 0.5").select("s1", F.col("rec").cast("string").alias("rid"))
    return rp.emptied(tb.id_lists(t, e), e, 2)


assert PAIRS
