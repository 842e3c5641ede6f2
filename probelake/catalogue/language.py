"""Queries of string functions, prompts, option masses and statement generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from probelake.catalogue.views import STMT, stmt
from probelake.functions import strings as X
from probelake.functions.hashing import h, h_sql
from probelake.operators import datagen as G
from probelake.operators import prompts as P
from probelake.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NAMES = f"names AS (SELECT row_id, object_1 AS s FROM stmt WHERE object_1 IS NOT NULL)"


def _names(spark, sf):
    return stmt(spark, sf, ["object_1"]).where("object_1 is not null").select("row_id", F.col("object_1").alias("s"))


@query(f"WITH {STMT}, {_NAMES} SELECT row_id, upper(s[1:1]) || lower(s[2:]) AS capital, upper(list_aggregate([w[1:1] FOR w IN regexp_split_to_array(trim(s), '\\s+') IF w <> ''], 'string_agg', '')) AS abbr, CAST(replace(s, '.', '') = upper(replace(s, '.', '')) AND regexp_matches(replace(s, '.', ''), '[A-Z]') AND length(replace(s, '.', '')) <= 5 AS INT) AS is_abbr FROM names WHERE regexp_matches(s, '^[ -~]+$') AND trim(s) <> ''")
def text_abbrev(spark, sf):
    n = _names(spark, sf).where(F.col("s").rlike("^[ -~]+\\z") & (F.trim("s") != ""))
    s = F.col("s")
    return n.select("row_id", X.capitalised(s).alias("capital"), X.abbreviated(s).alias("abbr"), X.is_abbreviation(s).cast("int").alias("is_abbr"))


_RAW = "SELECT row_id, correct_object_2 AS s FROM stmt WHERE correct_object_2 IS NOT NULL"


@query(f"WITH {STMT} SELECT row_id, regexp_replace(s, '\\(.*?\\)|\\[.*?\\]', '', 'g') AS bare, split_part(s, ',', 1) AS head, split_part(s, ';', 1) AS clause, trim(s, '#+ ') AS stripped, rtrim(s, '.d') AS charset, replace(s, '-', ' ') AS spaced, regexp_replace(s, 'd\\s*$', ' ') AS ended FROM ({_RAW} AND NOT contains(correct_object_2, chr(10)))")
def text_clean(spark, sf):
    n = stmt(spark, sf, ["correct_object_2"]).where("correct_object_2 is not null").where(~F.col("correct_object_2").contains("\n"))
    s = F.col("correct_object_2")
    return n.select("row_id", X.without_brackets(s).alias("bare"), X.first_part(s, ",").alias("head"), X.first_part(s, ";").alias("clause"), X.stripped(s).alias("stripped"), X.right_stripped(s, ".d").alias("charset"), F.replace(s, F.lit("-"), F.lit(" ")).alias("spaced"), X.without_end_token(s, "d").alias("ended"))


_DEF = "regexp_replace(trim(regexp_replace(s, '\\s*\\(.*?\\)\\s*', ' ', 'g'), ' '), ';.*$', '', 's')"
_BARE = f"regexp_matches(lower(d), '^({'|'.join(X.NO_ARTICLE)})') OR regexp_matches(lower(d), '^(a|an|the) ')"
_AN = "CASE WHEN lower(d[1:1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' ELSE 'a ' END || d"


@query(f"WITH {STMT}, r AS (SELECT row_id, object_2 AS s, CASE row_id % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' ELSE 'adverb' END AS pos FROM stmt WHERE object_2 IS NOT NULL AND object_2 <> ''), c AS (SELECT row_id, pos, {_DEF} AS d FROM r) SELECT row_id, trim(regexp_replace(CASE pos WHEN 'noun' THEN CASE WHEN {_BARE} THEN d ELSE {_AN} END WHEN 'verb' THEN CASE WHEN d[1:3] = 'to ' THEN d ELSE 'to ' || d END ELSE d END, '\\.$', ''), ' ') AS definition FROM c")
def text_definition(spark, sf):
    n = stmt(spark, sf, ["object_2"]).where("object_2 <> ''")
    pos = F.when(F.col("row_id") % 3 == 0, "noun").when(F.col("row_id") % 3 == 1, "verb").otherwise("adverb")
    return n.select("row_id", X.definition(F.col("object_2"), pos).alias("definition"))


_WORDS = "|".join(w.lower() for w in X.COUNTRY_WORDS)


@query(f"WITH {STMT}, w AS (SELECT row_id, object_2 AS s, split_part(lower(object_2), ' ', 1) AS f FROM stmt WHERE object_2 IS NOT NULL AND regexp_matches(object_2, '^[ -~]+$')) SELECT row_id, CASE WHEN regexp_matches(lower(s), '{_WORDS}') OR (regexp_matches(f, 's$') AND NOT regexp_matches(f, '(ss|us|is)$')) THEN 'the ' || s ELSE s END AS country FROM w")
def text_article(spark, sf):
    n = stmt(spark, sf, ["object_2"]).where(F.col("object_2").rlike("^[ -~]+\\z"))
    return n.select("row_id", X.country_with_article(F.col("object_2")).alias("country"))


@query(f"WITH {STMT}, r AS (SELECT row_id, object_2 AS t, (row_id % 101) / 100.0::DOUBLE AS w FROM stmt WHERE object_2 IS NOT NULL), s AS (SELECT *, CAST(round(255 * (1 - abs(2 * w - 1))) AS INT) AS side FROM r) SELECT row_id, '<span style=\"background-color:#' || CASE WHEN w >= 0.5 THEN 'ff' ELSE lpad(lower(to_hex(side)), 2, '0') END || lpad(lower(to_hex(side)), 2, '0') || CASE WHEN w <= 0.5 THEN 'ff' ELSE lpad(lower(to_hex(side)), 2, '0') END || '\">' || t || '</span>' AS span FROM s")
def text_colour_span(spark, sf):
    n = stmt(spark, sf, ["object_2"]).where("object_2 is not null")
    return n.select("row_id", X.coloured(F.col("object_2"), F.col("row_id") % 101 / F.lit(100.0)).alias("span"))


# prompts


def _prompt_sql(p: P.Prompt, ending: str = "") -> str:
    tail = f"{P.SELECT}{p.options}\n\nPlease respond with the corresponding {p.unit}. The final answer is {p.unit} {ending}"
    return f"WITH {STMT} SELECT row_id, {_lit(P.QUESTION)} || statement || {_lit(tail)} AS prompt FROM stmt WHERE length(statement) > 2"


def _prompt_query(p: P.Prompt, ending: str = ""):
    return lambda spark, sf: stmt(spark, sf, ["statement"]).where(F.char_length("statement") > 2).select("row_id", p.text(F.col("statement"), ending).alias("prompt"))


for _n, _p in P.VARIANTS.items():
    QUERIES[f"prompt_{_n}"], SQL[f"prompt_{_n}"] = _prompt_query(_p), _prompt_sql(_p)
QUERIES["prompt_masked"], SQL["prompt_masked"] = _prompt_query(P.VARIANTS["default"], "[MASK]."), _prompt_sql(P.VARIANTS["default"], "[MASK].")

_D = P.VARIANTS["default"]
_ASK = f"{_lit(P.QUESTION)} || statement || {_lit(P.SELECT_CHAT + _D.options + chr(10))}"


@query(f"WITH {STMT}, s AS (SELECT * FROM stmt WHERE length(statement) > 2) SELECT row_id, 0 AS at, 'system' AS role, {_lit(P.EXPERT + _D.unit + '.')} AS content FROM s UNION ALL SELECT row_id, 1, 'user', {_ASK} FROM s UNION ALL SELECT row_id, 2, 'assistant', {_lit(f'The final answer is {_D.unit} ')} FROM s")
def prompt_instruct(spark, sf):
    s = stmt(spark, sf, ["statement"]).where(F.char_length("statement") > 2)
    return s.select("row_id", F.posexplode(_D.chat(F.col("statement"))).alias("at", "m")).select("row_id", "at", "m.role", "m.content")


@query(f"WITH {STMT}, s AS (SELECT * FROM stmt WHERE length(statement) > 2) SELECT row_id, 0 AS at, 'user' AS role, {_lit(P.EXPERT + _D.unit + '.' + chr(10) * 2)} || {_ASK} AS content FROM s UNION ALL SELECT row_id, 1, 'assistant', {_lit(f'The final answer is {_D.unit} ')} FROM s")
def prompt_instruct_one_role(spark, sf):
    s = stmt(spark, sf, ["statement"]).where(F.char_length("statement") > 2)
    p = P.Prompt(system="user")
    return s.select("row_id", F.posexplode(p.chat(F.col("statement"))).alias("at", "m")).select("row_id", "at", "m.role", "m.content")


@query(f"SELECT {_lit(P.QUESTION)} AS intro")
def prompt_intro(spark, sf):
    return spark.range(1).select(_D.intro().alias("intro"))


@query(f"WITH {STMT}, r AS (SELECT row_id, rtrim(statement) AS s, string_split(object_2, ' ') AS w FROM stmt WHERE statement IS NOT NULL AND object_2 IS NOT NULL) SELECT row_id, k::INT AS at, CASE WHEN k = 0 THEN s ELSE s || ' ' || array_to_string(w[1:k], ' ') END AS prefix FROM (SELECT *, unnest(range(len(w) + 1)) AS k FROM r)")
def answer_prefixes(spark, sf):
    s = stmt(spark, sf, ["statement", "object_2"]).where("statement is not null and object_2 is not null")
    return s.select("row_id", F.posexplode(P.answer_prefixes(F.col("statement"), F.col("object_2"))).alias("at", "prefix"))


@query(f"WITH {STMT}, s AS (SELECT row_id, CASE WHEN contains(lower(object_1), 'city') THEN object_1 || ' is located in' ELSE 'The city of ' || object_1 || CASE WHEN negation = 0 THEN ' is' ELSE ' is not' END || ' located in' END AS st FROM stmt WHERE object_1 IS NOT NULL AND dataset LIKE 'city%') SELECT row_id, 0 AS at, 'system' AS role, {_lit(P.COMPLETE)} AS content FROM s UNION ALL SELECT row_id, 1, 'user', st FROM s")
def intervention_prompts(spark, sf):
    s = stmt(spark, sf, ["object_1", "negation", "dataset"]).where("object_1 is not null and dataset like 'city%'")
    st = G.stem("city_locations", F.col("object_1"), F.col("negation"))
    return s.select("row_id", F.posexplode(P.completion_chat(st)).alias("at", "m")).select("row_id", "at", "m.role", "m.content")


_STEM = "SELECT row_id, upper(object_1[1:1]) || lower(object_1[2:]) || CASE WHEN negation = 0 THEN ' is' ELSE ' is not' END || ' indicated for the treatment of' AS stem FROM stmt WHERE regexp_matches(object_1, '^[ -~]+$') AND dataset LIKE 'med%'"


@query(f"WITH {STMT} {_STEM}")
def intervention_stems(spark, sf):
    s = stmt(spark, sf, ["object_1", "negation", "dataset"]).where(F.col("object_1").rlike("^[ -~]+\\z") & F.col("dataset").like("med%"))
    return s.select("row_id", G.stem("med_indications", F.col("object_1"), F.col("negation")).alias("stem"))


# option masses of logits

_OPTS = [[3, 17], [5], [8, 21], [30]]
_LOGITS = "lg AS (SELECT vec_id, [10 * x::DOUBLE FOR x IN embedding] AS v FROM embeddings), sm AS (SELECT vec_id, v, [exp(x - list_max(v)) FOR x IN v] AS e FROM lg), p AS (SELECT vec_id, v, [x / list_sum(e) FOR x IN e] AS p FROM sm)"


def _logits(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: 10 * x.cast("double")).alias("v"))


def _mass_sql(agg: str) -> str:
    part = {"sum": "list_sum({})", "mean": "list_sum({}) / len({})", "max": "list_max({})"}[agg]
    each = [[f"p[{i + 1}]" for i in ids] for ids in _OPTS]
    cols = [part.replace("{}", "[" + ", ".join(x) + "]") for x in each]
    rest = "1 - " + " - ".join("(" + " + ".join(x) + ")" for x in each)
    return f"WITH {_LOGITS} SELECT vec_id, " + ", ".join(f"round({c}, 6) AS m{i}" for i, c in enumerate([*cols, rest])) + " FROM p"


def _mass_query(agg: str):
    def run(spark, sf):
        m = _logits(spark, sf).select("vec_id", P.option_masses(F.col("v"), _OPTS, agg).alias("m"))
        return m.select("vec_id", *[F.round(F.col("m")[i], 6).alias(f"m{i}") for i in range(len(_OPTS) + 1)])

    return run


for _a in ("sum", "mean", "max"):
    _name = "logit_collapse" if _a == "sum" else f"logit_collapse_{_a}"
    QUERIES[_name], SQL[_name] = _mass_query(_a), _mass_sql(_a)


@query(f"SELECT count(*) AS n, count(*) FILTER (coalesce(len(scores) = 4 AND abs(list_sum(scores) - 1) <= 0.01::DOUBLE, false)) AS valid FROM zero_shot_scores")
def logit_check(spark, sf):
    z = table(spark, sf, "zero_shot_scores")
    return z.agg(F.count("*").alias("n"), F.sum(P.masses_valid(F.col("scores"), 3).cast("bigint")).alias("valid"))


@query(f"WITH {_LOGITS}, u AS (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM lg) SELECT vec_id, i::INT AS token, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i)::INT - 1 AS at FROM u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) <= 5")
def logit_topn(spark, sf):
    return _logits(spark, sf).select("vec_id", F.posexplode(P.top_tokens(F.col("v"), 5)).alias("at", "token"))


_IDS = "ids AS (SELECT c_mktsegment AS opt, list_distinct([x % 997 FOR x IN list(c_custkey)]) AS ids FROM customer GROUP BY c_mktsegment)"


@query(f"WITH {_IDS}, u AS (SELECT opt, unnest(ids) AS token FROM ids), s AS (SELECT token FROM u GROUP BY token HAVING count(*) > 1) SELECT opt, token FROM u WHERE token NOT IN (SELECT token FROM s)")
def token_shared(spark, sf):
    ids = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("opt")).agg(F.collect_set(F.col("c_custkey") % 997).alias("ids"))
    return P.without_shared(ids).select("opt", F.explode("ids").alias("token"))


@query("SELECT r_regionkey, unnest([r_name, ' ' || r_name]) AS token FROM region")
def token_space_forms(spark, sf):
    return table(spark, sf, "region").select("r_regionkey", F.explode(P.with_space_forms(F.array("r_name"))).alias("token"))


# statement generation

_KV = "kv AS (SELECT DISTINCT 'City' || (c_custkey % 400) AS key, n_name AS value FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_WRONG = (
    f"{_KV}, vals AS (SELECT value AS wrong, row_number() OVER (ORDER BY {h_sql(3, 'value')}, value) AS place FROM (SELECT DISTINCT value FROM kv)), nv AS (SELECT count(*) AS n FROM vals), own AS (SELECT key, list_sort(list(value)) AS own FROM kv GROUP BY key), "
    f"dr AS (SELECT key, value, slot, attempt, {h_sql(3, 'key || chr(58) || value || chr(58) || slot || chr(58) || attempt')} % n + 1 AS place FROM kv, nv, range(1, 3) a(slot), range({G.ATTEMPTS}) b(attempt)), "
    "wr AS (SELECT d.key, d.value, d.slot, arg_min(v.wrong, d.attempt) AS wrong FROM dr d JOIN vals v USING (place) JOIN own o ON d.key = o.key WHERE NOT list_contains([lower(x) FOR x IN own], lower(wrong)) AND NOT list_has_any(flatten([string_split(lower(x), ' ') FOR x IN own]), string_split(lower(wrong), ' ')) GROUP BY d.key, d.value, d.slot)"
)
_GEN = (
    f"{_WRONG}, rows AS (SELECT key, value, unnest([true, false]) AS negation FROM kv UNION ALL SELECT key, wrong, slot = 1 FROM wr), "
    "gen AS (SELECT CASE WHEN contains(lower(r.key), 'city') THEN r.key ELSE 'The city of ' || r.key END || CASE WHEN negation THEN ' is not ' ELSE ' is ' END || 'located in ' || value || '.' AS statement, r.key AS object_1, value AS object_2, array_to_string(own, ', ') AS correct_object_2, "
    "(len([x FOR x IN own IF contains(lower(x), lower(value))]) > 0) <> negation AS correct, negation, true AS real_object FROM rows r JOIN own USING (key))"
)


def _kv(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit("City"), F.col("c_custkey") % 400).alias("key"), F.col("n_name").alias("value")).distinct()


@query(f"WITH {_WRONG} SELECT key, value, slot::INT AS slot, wrong FROM wr")
def gen_incorrect(spark, sf):
    return G.wrong_values(_kv(spark, sf))


@query(f"WITH {_GEN} SELECT * FROM gen")
def gen_statements(spark, sf):
    return G.generate(_kv(spark, sf)).withColumn("correct_object_2", F.array_join("correct_object_2", ", "))


@query(f"WITH {_GEN} SELECT correct, negation, count(*) AS n FROM gen GROUP BY correct, negation")
def gen_balance(spark, sf):
    return G.generate(_kv(spark, sf)).groupBy("correct", "negation").agg(F.count("*").alias("n"))


_PL = "CASE WHEN regexp_matches(split_part(lower(v), ' ', 1), 's$') AND NOT regexp_matches(split_part(lower(v), ' ', 1), '(ss|us|is)$') THEN v WHEN lower(v[1:1]) IN ('a', 'e', 'i', 'o', 'u') THEN 'an ' || v ELSE 'a ' || v END"
_CAPK = "upper(k[1:1]) || lower(k[2:])"


@query(f"WITH p AS (SELECT p_partkey, p_name AS k, p_type AS v, p_partkey % 2 = 0 AS n FROM part) SELECT p_partkey, CASE WHEN upper(k) = k THEN k ELSE {_CAPK} END || CASE WHEN n THEN ' is not ' ELSE ' is ' END || {_PL} || '.' AS instance, {_CAPK} || CASE WHEN n THEN ' is not ' ELSE ' is ' END || 'a type of ' || {_PL} || '.' AS type, {_CAPK} || CASE WHEN n THEN ' is not ' ELSE ' is ' END || 'a synonym of ' || {_PL} || '.' AS synonym, k || CASE WHEN n THEN ' is not ' ELSE ' is ' END || 'indicated for the treatment of ' || v || '.' AS drug FROM p")
def gen_templates(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("k"), F.col("p_type").alias("v"), (F.col("p_partkey") % 2 == 0).alias("n"))
    return p.select("p_partkey", *[G.template(kind, F.col("k"), F.col("v"), F.col("n")).alias(kind) for kind in ("instance", "type", "synonym", "drug")])


@query(f"WITH {STMT} SELECT row_id, dataset FROM stmt ORDER BY {h_sql(7, 'row_id')}, row_id LIMIT 300")
def gen_subsample(spark, sf):
    return G.subsample(stmt(spark, sf, ["dataset"]), 300, 7).select("row_id", "dataset")


@query(f"WITH {_KV} SELECT key, value FROM kv QUALIFY row_number() OVER (PARTITION BY key ORDER BY {h_sql(0, 'key || chr(58) || value')}, value) <= 2")
def gen_two_per_key(spark, sf):
    return G.drawn_per_key(_kv(spark, sf), 2)


@query(f"WITH {STMT}, a AS (SELECT DISTINCT object_2 AS n FROM stmt WHERE dataset = 'city_locations' AND object_2 IS NOT NULL), b AS (SELECT DISTINCT CASE WHEN row_id % 2 = 0 THEN object_2 ELSE lower(object_2) END AS n FROM stmt WHERE dataset = 'city_locations_synthetic' AND object_2 IS NOT NULL), u AS (SELECT lower(n) AS low, n FROM a WHERE lower(n) IN (SELECT lower(n) FROM b) UNION SELECT lower(n), n FROM b WHERE lower(n) IN (SELECT lower(n) FROM a)) SELECT low, n AS name FROM u QUALIFY row_number() OVER (PARTITION BY low ORDER BY CASE WHEN n[1:1] <> lower(n[1:1]) THEN 0 ELSE 1 END, n) = 1")
def names_agreeing(spark, sf):
    s = stmt(spark, sf, ["dataset", "object_2"]).where("object_2 is not null")
    a = s.where("dataset = 'city_locations'").select(F.col("object_2").alias("name"))
    b = s.where("dataset = 'city_locations_synthetic'").select(F.when(F.col("row_id") % 2 == 0, F.col("object_2")).otherwise(F.lower("object_2")).alias("name"))
    return G.names_agreeing(a, b)


@query(f"WITH {STMT} SELECT DISTINCT lower(object_1) AS name FROM stmt WHERE real_object = 0 AND object_1 IS NOT NULL AND lower(object_1) NOT IN (SELECT lower(object_1) FROM stmt WHERE real_object = 1 AND object_1 IS NOT NULL)")
def names_absent(spark, sf):
    s = stmt(spark, sf, ["real_object", "object_1"]).where("object_1 is not null").withColumnRenamed("object_1", "name")
    return G.absent_from(s.where("real_object = 0").select("name"), s.where("real_object = 1")).select(F.lower("name").alias("name"))


@query("SELECT c_nationkey AS nation, max(c_acctbal) AS population, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def max_and_set_per_key(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.max("c_acctbal").alias("population"), F.size(F.collect_set("c_mktsegment")).cast("bigint").alias("segments"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 700")
def top_keys(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(700)
