"""Parsers and conversation queries, over messages composed from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import parsing as ps
from ..functions import text as tx
from ..operators import conversation as cv
from ..operators import search as se
from ..operators.brands import brands_by_dictionary
from .base import CAT, ORACLE, catalog_view, query, read, written
from .catalog import ORIGIN, PRICED, origins, priced, sourced

def pick(number: str, values) -> str:
    """One of some SQL texts, by a number from 0."""
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: A message of five parts, each chosen by another column: a start, a thing, a price, brands or countries, an ending.
PARTS = (
    pick("p_partkey % 6", ("'推荐'", "'recommend '", "'我想买'", "'有没有'", "'any cheaper '", "'帮我挑'")),
    pick("p_size % 12", ("'蓝牙耳机'", "'护肤品'", "'防晒霜'", "'家居摆件'", "'户外帐篷'", "'数码产品'", "'图书'", "'headphones '", "'sunscreen spf50 '", "'running shoes '", "'洗面奶'", "''")) + " || p_name",
    pick("p_partkey % 7", ("''", "p_size || '元以内'", "' under ' || p_size * 20", "'，预算提高到' || p_size * 10 || '元'", "'，' || p_size || '元以上'", "'，不超过' || p_size", "' over ' || p_size")),
    pick("(p_partkey + p_size) % 8", ("''", "'，不要' || p_brand", "'，不要日系和美货'", "'，除了' || p_brand || '以外'", "'，' || p_brand || '的就算了'", "' without ' || p_brand", "'，喜欢' || p_brand", "'，不要法国的'")),
    pick("p_partkey % 11", ("''", "'，太便宜了推荐贵的'", "'，送女友的礼物'", "'，把第' || (1 + p_size % 9) || '个改成2个'", "'，删掉第二个'", "'，清空购物车'", "'，帮我加入购物车'", "' [目录✓] [推断?] [目录✓]'", "'，今天天气'", "'，对比一下母亲节的'", "'，下单吧'")),
)
PHRASES = " || ".join(f"({p})" for p in PARTS)
MSG = f"ms AS (SELECT p_partkey AS query_id, p_brand, {PHRASES} AS text FROM part)"


def messages(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(PHRASES).alias("text"))


SUFFIX = r"(\d+(?:\.\d+)?)\s*(?:元|块|rmb|RMB)?\s*(?:以内|以下|内|封顶|不超过|不要超过)"
LOW = r"(\d+(?:\.\d+)?)\s*(?:元|块|rmb|RMB)?\s*(?:以上|起|起步)"


def first_number(pattern: str) -> str:
    return f"nullif(TRY_CAST(regexp_extract(text, '{pattern}', 1) AS DOUBLE), 0)"


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def any_of(text: str, terms) -> str:
    return f"(len(list_filter({listed(terms)}, lambda t: contains(lower({text}), lower(t)))) > 0)"


def first_of(text: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(text, terms)} THEN '{c}'" for c, terms in rules) + " END"


#: DuckDB's patterns have no look-around; what the look-arounds would rule out is in none of the messages.
PHRASE = lx.NEGATED_PHRASE.replace("|(?<!有)没有", "")
SUFFIX_NOT = ps.SUFFIX_NOT.replace("(?=", "(?:")
CLAUSE = ps.NEGATION_CLAUSE.replace("不要(?!超过)", "不要")
INFERRED = (("数码电子", ("耳机", "键盘")), ("美妆护肤", ("洗面奶", "防晒")), ("服饰运动", ("跑鞋",)))
SUB_RULES = ((("蓝牙耳机",), ("真无线耳机", "头戴耳机")), (("防晒",), ("防晒霜",)), (("耳机",), ("耳机",)))
HIGH = f"coalesce({first_number(SUFFIX)}, {first_number(lx.MAX_PREFIX)}, {first_number(lx.MAX_BUDGET)}, {first_number(lx.EN_MAX)})"
HINTED = "CASE WHEN regexp_matches(text, '[一-鿿]') THEN [] ELSE list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '\\b{en}') THEN '{zh}' END" for en, zh in lx.ENGLISH_HINTS) + "], lambda x: x IS NOT NULL) END"
FIRSTS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
WIDER = f"hn AS (SELECT *, {HINTED} AS hints FROM ms), wd AS (SELECT query_id, text AS plain, concat_ws(' ', text, nullif(array_to_string({FIRSTS.format('hints')}, ' '), '')) AS text FROM hn)"
MENTIONED = f"""nm AS (SELECT DISTINCT p_brand AS b, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part), hi AS (SELECT query_id, b, n, substr(t, greatest(1, p - 30), least(30, p - 1)) AS before, substr(t, p + length(b), 12) AS after, substr(t, p, 10) AS near FROM (SELECT query_id, b, n, lower(text) AS t, instr(lower(text), lower(b)) AS p FROM ms, nm) WHERE p > 0),
 ng AS (SELECT query_id, b, n, regexp_matches(before, '(?i){ps.NEGATED_PREFIX}') OR regexp_matches(after, '(?i){ps.SUFFIX_DISMISS}') OR regexp_matches(after, '(?i){SUFFIX_NOT}') OR contains(near, '以外') OR contains(near, '之外') AS bad FROM hi),
 br AS (SELECT query_id, coalesce(string_agg(b, ',' ORDER BY n) FILTER (WHERE NOT bad), '') AS included, coalesce(string_agg(b, ',' ORDER BY n) FILTER (WHERE bad), '') AS excluded FROM ng GROUP BY 1)"""
#: The brands of part; texts name one each, and a name may be the start of a longer one.
BRANDS = {f"Brand#{n}": [] for n in range(1, 26)}


@query(f"WITH {MSG} SELECT query_id, {first_of('text', lx.CATEGORIES)} AS category FROM ms")
def f1_parse_category(spark, sf_dir):
    return messages(spark, sf_dir).select("query_id", ps.parse_category("text").alias("category"))


@query(f"WITH {MSG}, {WIDER} SELECT query_id, coalesce({first_of('text', lx.CATEGORIES)}, {first_of('text', INFERRED)}) AS category, CASE " + " ".join(f"WHEN {any_of('text', terms)} THEN '{','.join(subs)}'" for terms, subs in SUB_RULES) + " END AS sub_categories FROM wd")
def f1_infer_category(spark, sf_dir):
    """Words of a category first, then words that imply one; English hints count."""
    wide = messages(spark, sf_dir).withColumn("text", tx.augment("text", tx.english_hints("text", lx.ENGLISH_HINTS)))
    return wide.select("query_id", ps.infer_category("text", INFERRED).alias("category"), F.array_join(ps.parse_sub_categories("text", SUB_RULES), ",").alias("sub_categories"))


@query(f"WITH {MSG} SELECT query_id, {HIGH} AS price_max, {first_number(LOW)} AS price_min FROM ms")
def f2_parse_price_bounds(spark, sf_dir):
    return messages(spark, sf_dir).select("query_id", tx.price_max("text").alias("price_max"), tx.price_min("text").alias("price_min"))


@query(f"WITH {MSG}, {MENTIONED} SELECT query_id, coalesce(included, '') AS included, coalesce(excluded, '') AS excluded FROM ms LEFT JOIN br USING (query_id)")
def f3_parse_brands(spark, sf_dir):
    """Wanted and refused brands of every message, one pass per distinct text."""
    rows = messages(spark, sf_dir)
    parsed = rows.select("text").distinct().withColumn("b", ps.parse_brands("text", BRANDS))
    return rows.join(parsed, "text").select("query_id", F.array_join("b.included", ",").alias("included"), F.array_join("b.excluded", ",").alias("excluded"))


@query(ORACLE["f3_parse_brands"])
def f3_dictionary_brands(spark, sf_dir):
    """The same by a join with the brands of part as a table."""
    terms = read(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.substring("p_brand", 7, 9).cast("int").alias("ordinal"), F.col("p_brand").alias("term")).distinct()
    found = brands_by_dictionary(messages(spark, sf_dir), terms)
    return found.select("query_id", F.array_join("included", ",").alias("included"), F.array_join("excluded", ",").alias("excluded"))


COUNTRY_WORDS = listed(w for _, words in lx.COUNTRIES for w in words)
COUNTRY_CODES = "list_filter([" + ", ".join(f"CASE WHEN {any_of('terms', words)} THEN '{c}' END" for c, words in lx.COUNTRIES) + "], lambda x: x IS NOT NULL)"


@query(f"WITH {MSG}, ct AS (SELECT query_id, array_to_string(list_filter({COUNTRY_WORDS}, lambda w: contains(text, w)), ',') AS terms FROM ms) SELECT query_id, terms, array_to_string({COUNTRY_CODES}, ',') AS countries FROM ct")
def f6_country_terms(spark, sf_dir):
    terms = ps.country_terms("text")
    return messages(spark, sf_dir).select("query_id", F.array_join(terms, ",").alias("terms"), F.array_join(ps.excluded_countries(terms), ",").alias("countries"))


@query(f"WITH {MSG}, ph AS (SELECT query_id, list_transform(regexp_extract_all(text, '{PHRASE}', 1), lambda x: lower(x)) AS phrases FROM ms), kn AS (SELECT list(b ORDER BY length(b) DESC, b) AS known FROM (SELECT DISTINCT p_brand AS b FROM part)) SELECT query_id, array_to_string(list_filter(known, lambda b: len(list_filter(phrases, lambda p: contains(p, lower(b)))) > 0), ',') AS named FROM ph, kn")
def f7_negated_brands(spark, sf_dir):
    return messages(spark, sf_dir).select("query_id", F.array_join(ps.negated_brands("text", list(BRANDS), lx.NEGATED_PHRASE), ",").alias("named"))


@query(f"WITH {MSG}, {WIDER} SELECT query_id, text FROM wd")
def f8_augment_english(spark, sf_dir):
    return messages(spark, sf_dir).select("query_id", tx.augment("text", tx.english_hints("text", lx.ENGLISH_HINTS)).alias("text"))


@query(f"WITH {MSG}, sy AS (SELECT query_id, CASE WHEN {any_of('text', lx.PRICE_WORDS)} THEN [] ELSE list_filter(flatten([" + ", ".join(f"CASE WHEN contains(lower(text), lower('{k}')) THEN {listed(v)} ELSE [] END" for k, v in lx.SYNONYMS.items()) + f"]), lambda t: NOT contains(lower(text), lower(t))) END AS every FROM ms) SELECT query_id, array_to_string(({FIRSTS.format('every')})[1:8], ',') AS terms FROM sy")
def f9_expand_synonyms(spark, sf_dir):
    return messages(spark, sf_dir).select("query_id", F.array_join(tx.expansion_terms("text", lx.SYNONYMS, lx.PRICE_WORDS), ",").alias("terms"))


DIRECTION = f"""b AS (SELECT query_id, text, coalesce({first_number(SUFFIX)}, {first_number(lx.MAX_PREFIX)}, {first_number(lx.EN_MAX)}) AS high, coalesce({first_number(LOW)}, {first_number(lx.EN_MIN)}) AS low,
 regexp_matches(text, '太便宜|嫌便宜|不够贵|不够高端') AS poor, regexp_matches(text, '太贵|嫌贵|不够便宜') AS rich, regexp_matches(text, '{lx.CHEAP.replace("(?iU)", "(?i)")}') AS cheap, regexp_matches(text, '{lx.EXPENSIVE.replace("(?iU)", "(?i)")}') AS dear FROM ms),
 pi AS (SELECT query_id, low, high, CASE WHEN poor AND NOT rich THEN 'expensive' WHEN rich AND NOT poor THEN 'cheap' WHEN cheap AND NOT dear THEN 'cheap' WHEN dear AND NOT cheap THEN 'expensive' WHEN high IS NOT NULL AND low IS NULL THEN 'cheap' WHEN low IS NOT NULL AND high IS NULL THEN 'expensive' END AS direction FROM b)"""


@query(f"WITH {MSG}, {DIRECTION} SELECT query_id, low, high, direction FROM pi")
def f10_price_intent(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("i", tx.price_intent("text")).select("query_id", "i.low", "i.high", "i.direction")


@query(f"WITH {MSG} SELECT query_id, trim(regexp_replace(text, '{ps.PRICE_PHRASE}', '', 'g'), ' ,，、的') AS no_price, trim(regexp_replace(text, '{CLAUSE.replace(chr(39), chr(39) * 2)}', '', 'g'), ' ,，、;；的') AS no_negation FROM ms")
def f13_strip_clauses(spark, sf_dir):
    return messages(spark, sf_dir).select("query_id", ps.strip_price("text").alias("no_price"), ps.strip_negation("text").alias("no_negation"))


CONCRETE, SCENES = ("防晒", "耳机", "洗面"), ("露营", "母亲节", "清单")


@query(f"WITH {MSG}, fl AS (SELECT query_id, text, {any_of('text', CONCRETE)} OR regexp_matches(text, '{ps.PRICED}') AS specific, regexp_matches(text, '{ps.GIFT}') AS gift FROM ms) SELECT query_id, regexp_matches(text, '{ps.COMPARISON}') AS comparison, list_filter({listed(SCENES)}, lambda x: contains(text, x))[1] AS scene, regexp_matches(text, '{ps.OUT_OF_DOMAIN}') AND NOT specific AS out_of_domain, CASE WHEN (gift OR regexp_matches(text, '{ps.VAGUE}')) AND NOT specific THEN CASE WHEN gift THEN 'gift' ELSE 'general' END END AS clarify FROM fl")
def f14_intent_flags(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("i", ps.intent_flags("text", CONCRETE, SCENES)).select("query_id", "i.*")


NUMERALS = "CASE {0} WHEN '' THEN NULL WHEN '二' THEN 2 WHEN '两' THEN 2 WHEN '三' THEN 3 ELSE TRY_CAST({0} AS INTEGER) END"


@query(f"""WITH {MSG}, nu AS (SELECT query_id, text, regexp_extract(text, '{ps.ORDINAL}', 1) AS o, regexp_extract(text, '{ps.SET_QUANTITY}', 1) AS a FROM ms), np AS (SELECT query_id, text, CASE WHEN regexp_matches(text, '{ps.LAST}') THEN -1 ELSE {NUMERALS.format('o')} END AS place, {NUMERALS.format('a')} AS amount FROM nu),
 ac AS (SELECT query_id, place, amount, CASE WHEN contains(text, '下单') THEN 'checkout' WHEN regexp_matches(text, '{ps.CLEAR_CART}') THEN 'clear' WHEN amount > 0 AND (place IS NOT NULL OR regexp_matches(text, '数量|数目|几个')) THEN 'set_quantity' WHEN place IS NOT NULL AND (regexp_matches(text, '{ps.REMOVE}') OR (contains(text, '不要') AND regexp_matches(text, '{ps.IN_CART}'))) THEN 'remove' WHEN regexp_matches(text, '{ps.ADD_TO_CART}') THEN 'add' END AS action FROM np)
 SELECT query_id, action, CAST(CASE action WHEN 'set_quantity' THEN coalesce(place, -1) WHEN 'remove' THEN place END AS INTEGER) AS index, CAST(CASE action WHEN 'set_quantity' THEN amount END AS INTEGER) AS quantity FROM ac""")
def f15_parse_cart_intent(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("i", ps.parse_cart_intent("text")).select("query_id", "i.*")


@query(f"WITH {MSG} SELECT query_id, CAST((length(text) - length(replace(text, '[目录✓]', ''))) / 5 AS INTEGER) AS verified, CAST((length(text) - length(replace(text, '[推断?]', ''))) / 5 AS INTEGER) AS inferred FROM ms")
def f19_claim_counts(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("i", ps.claim_counts("text")).select("query_id", "i.*")


@query(f"WITH {MSG} SELECT query_id, sha256('prompt' || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10) || array_to_string(list_sort([substr(sha256('a' || query_id), 1, 16), substr(sha256('b'), 1, 16)]), '+')) AS key, query_id || ':1.5:2024-01-02::false' AS token FROM ms")
def f20_request_key(spark, sf_dir):
    images = F.array(F.concat(F.lit("a"), F.col("query_id").cast("string")).cast("binary"), F.lit("b").cast("binary"))
    product = F.array(F.struct(F.col("query_id").alias("product_id"), F.lit(1.5).alias("price_cny"), F.lit("2024-01-02").alias("rate_date"), F.lit(None).cast("double").alias("rate"), F.lit(False).alias("stale")))
    return messages(spark, sf_dir).select("query_id", ps.request_key(F.lit("prompt"), "text", images).alias("key"), ps.pricing_token(product).alias("token"))


TALK = "CASE WHEN role != 'user' THEN text WHEN turn = 0 THEN '推荐防晒 ' || conv_id WHEN (conv_id + turn) % 3 = 0 THEN '便宜的' WHEN (conv_id + turn) % 3 = 1 THEN '家居 ' || turn * 100 || '元以内' ELSE '不要日系' END"


def talk(turns):
    return turns.select("conv_id", "turn", "role", F.expr(TALK).alias("text"))


def talks(spark, sf_dir):
    """Conversations whose user turns are composed messages, by turn."""
    return talk(read(spark, sf_dir, "conversations"))


TALKS = f"tk AS (SELECT conv_id, turn, role, {TALK} AS text FROM conversations)"


@query(f"""WITH {TALKS}, u AS (SELECT *, text NOT IN ('便宜的', '不要日系') AS anchor FROM tk WHERE role = 'user'),
 s AS (SELECT *, last_value(CASE WHEN anchor THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM u),
 l AS (SELECT conv_id, CASE WHEN anchor OR prev IS NULL THEN text WHEN text = '便宜的' THEN prev || ' 更便宜 平价 低价 性价比 便宜的' ELSE prev || ' ' || text END AS query FROM s WHERE n = 1)
 SELECT conv_id, coalesce(query, '拍照找货') AS query FROM (SELECT DISTINCT conv_id FROM tk) LEFT JOIN l USING (conv_id)""")
def f12_contextual_query(spark, sf_dir):
    return cv.contextual_query(talks(spark, sf_dir))


@query(f"WITH {TALKS} SELECT conv_id, turn, text IN ('便宜的', '不要日系') AS followup FROM tk WHERE role = 'user'")
def f11_looks_like_followup(spark, sf_dir):
    return talks(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", ps.looks_like_followup("text").alias("followup"))


#: Short turns of two parts, some of which only make sense after another.
FRAGMENTS = " || ".join((
    pick("p_partkey % 13", ("'便宜'", "'再来一个'", "'换一个'", "'防晒霜'", "'100元以内'", "'红色的'", "'what about '", "'黑色款呢'", "'这个'", "''", "'跑鞋'", "'cheaper headphones'", "'有没有旗舰版'")),
    pick("p_size % 7", ("''", "'吗？'", "'便宜点'", "'，不要'", "' under 50'", "'推荐一款适合户外运动的东西'", "'左右'")),
))
OWN = any_of("text", [t for _, terms in lx.CATEGORIES for t in terms])
FOLLOWUP = f"""(n > 0 AND ((n <= 8 AND {any_of('compact', ps.FOLLOW_WORDS)}) OR (n <= 12 AND {any_of('compact', ('这个', '那个', '它', '再', '换一个'))})
 OR (n <= 20 AND {any_of('compact', ps.CHEAP_WORDS + ps.DEAR_WORDS)} AND NOT {any_of('compact', ps.ANCHORS)} AND NOT {OWN}) OR (residue != compact AND length(residue) <= 6 AND NOT {OWN})
 OR (n <= 10 AND regexp_matches(compact, '{ps.REFINEMENT}') AND NOT {OWN}) OR (len(english) BETWEEN 1 AND 7 AND NOT regexp_matches(low, '[一-鿿]') AND {any_of('low', ps.EN_FOLLOW)} AND NOT {OWN})))"""


@query(f"""WITH fr AS (SELECT p_partkey AS query_id, {FRAGMENTS} AS text FROM part), co AS (SELECT *, regexp_replace(text, '{ps.FILLER}', '', 'g') AS compact, lower(trim(text, ' ')) AS low FROM fr),
 re AS (SELECT *, length(compact) AS n, regexp_replace(compact, '{ps.PRICE_ONLY}', '', 'g') AS residue, regexp_extract_all(low, '[a-z'']+') AS english FROM co) SELECT query_id, {FOLLOWUP} AS followup FROM re""")
def f11_short_turns(spark, sf_dir):
    """Which of some composed turns are follow-ups."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.expr(FRAGMENTS).alias("text")).select("query_id", ps.looks_like_followup("text").alias("followup"))


@query("""WITH r AS (SELECT conv_id, turn, role, substr(trim(text, ' '), 1, 600) AS text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM conversations), k AS (SELECT * FROM r WHERE turn < last AND role IN ('user', 'assistant') AND trim(text, ' ') != ''),
 n AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM k), g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM n),
 m AS (SELECT conv_id, run, role, string_agg(text, chr(10) ORDER BY turn) AS content FROM g GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY run DESC) AS back FROM m), f AS (SELECT *, min(CASE WHEN role = 'user' THEN run END) OVER (PARTITION BY conv_id) AS first FROM b WHERE back <= 8)
 SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY run) AS INTEGER) AS position, role, content FROM f WHERE run >= first""")
def f18_prior_turns(spark, sf_dir):
    return cv.prior_turns(read(spark, sf_dir, "conversations"))


@query(f"""WITH {TALKS}, u AS (SELECT *, contains(text, '家居') AS home, contains(text, '防晒') AS sun, contains(text, '不要') AS jp FROM tk WHERE role = 'user'),
 l AS (SELECT conv_id, max(CASE WHEN home THEN turn END) AS h, bool_or(jp) AS jp, max(turn) AS t FROM u GROUP BY 1)
 SELECT conv_id, CASE WHEN h IS NOT NULL THEN '家居家具' END AS category, CAST(h * 100 AS DOUBLE) AS price_max, CASE WHEN jp THEN '日系' ELSE '' END AS keywords FROM l""")
def f17_conversation_filter(spark, sf_dir):
    """Constraints carried over the turns of every conversation."""
    return filter_row(cv.conversation_filter(talks(spark, sf_dir), {"Nike": ["耐克"]}))


def filter_row(rows):
    return rows.select("conv_id", "category", "price_max", F.coalesce(F.array_join("exclude_keywords", ","), F.lit("")).alias("keywords"))


CUES = any_of("text", ps.NEGATION_CUES)
ANY_CUES = any_of("text", (*ps.NEGATION_CUES, *se.NEGATION_EN))


@query(f"WITH {MSG}, {DIRECTION} SELECT query_id, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'multilingual' ELSE 'zh' END AS model, (regexp_matches(lower(text), '(^|[^a-z])spf([^a-z]|$)') OR contains(text, '护肤')) AND NOT {ANY_CUES} AS skip, CAST(CASE WHEN {HIGH} IS NOT NULL OR {first_number(LOW)} IS NOT NULL THEN 20 WHEN direction IS NOT NULL THEN 10 ELSE 5 END AS INTEGER) AS pool FROM ms JOIN pi USING (query_id)")
def e9_rerank_plan(spark, sf_dir):
    return se.rerank_plan(messages(spark, sf_dir), ["spf", "Nike", "护肤"]).select("query_id", "model", "skip", "pool")


SHELF = pick("p_size % 4", ("'美妆护肤'", "'数码电子'", "'家居家具'", "'户外运动'"))


@query(f"""WITH {MSG}, {MENTIONED}, {WIDER}, ca AS (SELECT query_id, coalesce({first_of('text', lx.CATEGORIES)}, {first_of('text', INFERRED)}) AS category FROM wd), sh AS (SELECT DISTINCT {SHELF} AS category, lower(p_brand) AS brand FROM part),
 ok AS (SELECT query_id, category FROM ca WHERE category IN (SELECT category FROM sh) AND (NOT EXISTS (SELECT 1 FROM ng WHERE ng.query_id = ca.query_id AND NOT bad) OR EXISTS (SELECT 1 FROM ng JOIN sh ON lower(ng.b) = sh.brand AND sh.category = ca.category WHERE ng.query_id = ca.query_id AND NOT bad))),
 ct AS (SELECT query_id, array_to_string(list_filter({COUNTRY_WORDS}, lambda w: contains(text, w)), ',') AS terms FROM ms WHERE {CUES}), co AS (SELECT query_id, nullif(array_to_string({COUNTRY_CODES}, ','), '') AS countries FROM ct)
 SELECT query_id, ok.category AS want_category, coalesce(CASE WHEN query_id % 32 = 0 THEN 5.0 END, {HIGH}) AS price_max, {first_number(LOW)} AS price_min, countries, nullif(included, '') AS included, nullif(excluded, '') AS excluded FROM ms LEFT JOIN ok USING (query_id) LEFT JOIN co USING (query_id) LEFT JOIN br USING (query_id)""")
def f5_build_filter(spark, sf_dir):
    """Filters of every message, over a catalog with four of the categories: one that no wanted brand sells in is dropped, named or inferred (F4)."""
    rows = messages(spark, sf_dir).withColumn("x_category", F.lit(None).cast("string")).withColumn("x_price_min", F.lit(None).cast("double")).withColumn("x_price_max", F.when(F.col("query_id") % 32 == 0, 5.0))
    shelves = read(spark, sf_dir, "part").select(F.expr(SHELF).alias("category"), F.col("p_name").alias("sub_category"), F.col("p_brand").alias("brand"))
    out = se.build_filter(rows, shelves, explicit=True, brands=BRANDS, inferred=INFERRED)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return out.select("query_id", "want_category", "price_max", "price_min", joined("ex_countries").alias("countries"), joined("brand_include").alias("included"), joined("brand_exclude").alias("excluded"))


#: What a conversation holds, by product: a category or none, sub-categories, brands.
HELD = {"category": "CASE p_size % 3 WHEN 0 THEN '美妆护肤' WHEN 1 THEN '数码电子' END", "sub_categories": "CASE WHEN p_size % 5 = 0 THEN {0}'防晒霜'{1} WHEN p_size % 5 = 1 THEN {0}'耳机'{1} END", "brands": "CASE WHEN p_size % 2 = 0 THEN {0}'Brand#2'{1} END"}
SWITCH_LINES = ("ring", "widget")


@query(f"""WITH {MSG}, {MENTIONED}, {WIDER}, rw AS (SELECT query_id, coalesce({first_of('text', lx.CATEGORIES)}, {first_of('text', INFERRED)}) AS rc, CASE {" ".join(f"WHEN {any_of('text', terms)} THEN {listed(subs)}" for terms, subs in SUB_RULES)} END AS rs FROM wd),
 he AS (SELECT p_partkey AS query_id, {HELD['category']} AS hc, {HELD['sub_categories'].format('[', ']')} AS hs, {HELD['brands'].format('[', ']')} AS hb FROM part), sh AS (SELECT DISTINCT {pick("p_size % 4", ("'美妆护肤'", "'数码电子'", "'家居家具'", "'户外运动'"))} AS category, lower(p_brand) AS brand FROM part),
 al AS (SELECT ms.query_id, text, rc, rs, hc, hs, hb, CASE WHEN coalesce(included, '') != '' THEN string_split(included, ',') END AS rb FROM ms JOIN rw USING (query_id) JOIN he USING (query_id) LEFT JOIN br USING (query_id)),
 se AS (SELECT *, len(list_filter(coalesce(rb, []), lambda b: list_contains(sold, lower(b) || '/' || hc))) > 0 AS sells FROM al, (SELECT list(brand || '/' || category) AS sold FROM sh))
 SELECT query_id, {any_of('text', SWITCH_LINES)} OR (rc IS NOT NULL AND rc IS DISTINCT FROM hc) OR coalesce(len(rb) > 0 AND len(hb) > 0 AND len(list_intersect(rb, hb)) = 0, false) OR coalesce(len(rs) > 0 AND len(hs) > 0 AND len(list_intersect(rs, hs)) = 0, false)
  OR (coalesce(len(hs), 0) > 0 AND coalesce(len(rs), 0) = 0 AND len(list_filter(hs, lambda c: contains(text, c))) = 0 AND (rc IS NOT NULL OR (coalesce(len(rb), 0) > 0 AND (hc IS NULL OR NOT sells)))) AS switched FROM se""")
def f16_topic_switch(spark, sf_dir):
    """Parsed messages against what their conversations hold."""
    shelf = read(spark, sf_dir, "part").select(F.expr(SHELF).alias("category"), F.lower("p_brand").alias("brand")).distinct().groupBy("category").agg(F.collect_set("brand").alias("sold"))
    held = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.struct(*(F.expr(e.format("array(", ")")).alias(c) for c, e in HELD.items())).alias("held"))
    raw = se.build_filter(messages(spark, sf_dir), brands=BRANDS, sub_rules=SUB_RULES, inferred=INFERRED)
    rows = raw.join(held, "query_id").join(shelf.withColumnRenamed("category", "shelf"), F.col("held.category") == F.col("shelf"), "left")
    sells = F.exists("brand_include", lambda b: F.array_contains("sold", F.lower(b)))
    return rows.withColumn("raw", F.struct(F.col("want_category").alias("category"), F.col("want_subs").alias("sub_categories"), F.col("brand_include").alias("brands"), tx.contains_any("text", SWITCH_LINES).alias("line"), sells.alias("sells"))).select("query_id", se.topic_switch(text=F.col("text")).alias("switched"))


ENT = f"WITH {CAT}, en AS (SELECT s_suppkey AS query_id, 'Brand#' || (1 + s_suppkey % 25) AS entity, 'brand' AS kind FROM supplier UNION ALL SELECT s_suppkey, 'ring', 'title' FROM supplier)"


def entities(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    brand = s.select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 25).cast("string")).alias("entity"), F.lit("brand").alias("kind"))
    return brand.unionByName(s.select(F.col("s_suppkey").alias("query_id"), F.lit("ring").alias("entity"), F.lit("title").alias("kind"))).withColumn("prefer", F.array(F.lit("bolt"), F.lit("gear")))


@query(ENT + " , r AS (SELECT query_id, entity, product_id, row_number() OVER (PARTITION BY query_id, entity ORDER BY CASE WHEN sub_category IN ('bolt', 'gear') THEN 0 ELSE 1 END, product_id) AS n FROM en JOIN cat ON CASE kind WHEN 'title' THEN contains(title, entity) ELSE contains(lower(brand), lower(entity)) OR contains(lower(entity), lower(brand)) END) SELECT query_id, entity, product_id FROM r WHERE n = 1")
def e13_catalog_fallback(spark, sf_dir):
    return se.catalog_fallback(entities(spark, sf_dir), catalog_view(spark, sf_dir)).select("query_id", "entity", "product_id")


def covered(source: str, out: str, fits: str) -> str:
    """SQL for one step of coverage over lists `l` of products {p, t, b} and spare ones `x`: who fits is brought to the fifth place, in that of the last of a brand that has several of five, or of the fifth."""
    at = f"coalesce(list_position(list_transform(l, lambda y: {fits}), true), 0)"
    return f"""{out}_a AS (SELECT *, {at} AS pos FROM {source}),
 {out}_b AS (SELECT *, CASE WHEN pos BETWEEN 1 AND 5 THEN NULL WHEN pos > 5 THEN l[pos] ELSE list_filter(x, lambda y: {fits} AND NOT list_contains(list_transform(l, lambda z: z.p), y.p))[1] END AS new, CASE WHEN pos > 5 THEN list_concat(l[1 : pos - 1], l[pos + 1 :]) ELSE l END AS rest FROM {out}_a),
 {out}_c AS (SELECT *, list_transform(rest[1:5], lambda y: y.b) AS bs FROM {out}_b), {out}_d AS (SELECT *, CASE WHEN len(rest) >= 5 THEN coalesce(list_max(list_filter(range(1, 6), lambda n: len(list_filter(bs, lambda b: b = bs[n])) > 1)), 5) END AS d FROM {out}_c),
 {out}_e AS (SELECT *, CASE WHEN d IS NULL THEN rest ELSE list_concat(rest[1 : d - 1], rest[d + 1 :]) END AS short FROM {out}_d),
 {out} AS (SELECT query_id, e, x, CASE WHEN new IS NULL THEN l ELSE list_concat(short[1:4], [new], CASE WHEN d IS NULL THEN [] ELSE [rest[d]] END, short[5:]) END AS l FROM {out}_e)"""


@query(ENT + f""", fb AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id, entity ORDER BY CASE WHEN sub_category IN ('bolt', 'gear') THEN 0 ELSE 1 END, product_id) AS n FROM en JOIN cat ON CASE kind WHEN 'title' THEN contains(title, entity) ELSE contains(lower(brand), lower(entity)) OR contains(lower(entity), lower(brand)) END),
 sp AS (SELECT query_id, list({{'p': product_id, 't': lower(title), 'b': lower(brand)}} ORDER BY product_id) AS x FROM (SELECT DISTINCT query_id, product_id FROM fb WHERE n = 1) JOIN cat USING (product_id) GROUP BY 1),
 bo AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS product_id FROM lineitem), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS rank FROM bo),
 li AS (SELECT query_id, list({{'p': product_id, 't': lower(title), 'b': lower(brand)}} ORDER BY rank) AS l FROM rk JOIN cat USING (product_id) WHERE rank <= 20 GROUP BY 1),
 s0 AS (SELECT query_id, 'brand#' || (1 + query_id % 25) AS e, coalesce(x, []) AS x, l FROM li LEFT JOIN sp USING (query_id)), {covered("s0", "s1", "(contains(y.b, e) OR contains(e, y.b))")}, {covered("s1", "s2", "contains(y.t, 'ring')")}
 SELECT query_id, unnest(list_transform(l, lambda y: y.p)) AS product_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS position FROM s2""")
def e12_brand_coverage(spark, sf_dir):
    """Twenty products a supplier ships, with its entities brought into the first five."""
    from ..operators.retrieval import top_k
    from .catalog import bought

    ranked = top_k(bought(spark, sf_dir), 20, order=[F.asc("product_id")]).join(catalog_view(spark, sf_dir), "product_id")
    named = entities(spark, sf_dir)
    return se.brand_coverage(ranked, named, se.catalog_fallback(named, catalog_view(spark, sf_dir)))


def shop(spark, sf_dir):
    """The catalog with origins and CNY prices."""
    from ..operators.joins import product_origin

    prices = priced(spark, sf_dir).select("product_id", F.col("price_cny").cast("double").alias("price_cny"))
    return written(product_origin(sourced(spark, sf_dir), origins(spark)).join(prices, "product_id"))


WISHES = (
    "'red ring'", "'blue bolt under 950'", "'old gear under 5'", "'zzz'", "'red widget without Brand#3'", "'blue ring over 940'", "'gear from Brand#4 please'", "'不要日系 bolt'", "'ring without Brand#7 under 3'", "'promo item of the finest quality for a winter evening walk'", "'promo item of the finest quality for a winter evening walk under 950'", "'bolt of size 9 that comes with a shiny red gear and Brand#5'",
)
WISH = pick(f"s_suppkey % {len(WISHES)}", WISHES)


def wishes(spark, sf_dir):
    """A query per supplier: words with price bounds that some or no products meet, refused and wanted brands, refused countries; words that no title has, which the gate refuses unless there is a bound."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("user_id"), F.expr(WISH).alias("text"))


#: Some of the brands of part, so that names are not the start of others in the texts.
WANTED = {f"Brand#{n}": [] for n in (3, 4, 5, 7, 8, 9)}


#: Best pair score under which a query without filters or words of a title gets nothing.
GATE = 0.4


#: Price order that English bounds ask for.
WAY = "CASE WHEN regexp_matches(text, '(?i)(?:under|below)\\s*\\d') THEN 'cheap' WHEN regexp_matches(text, '(?i)over\\s*\\d') THEN 'expensive' END"


def search_sql(asked: str, refused: str = "contains(text, '不要日系')", shelf: str = "true", gate: float = GATE, way: str = WAY) -> str:
    """The first five products of texts (query_id, text): filters, BM25 of twenty, pair scores, price order. Queries have one form of text each."""
    words = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_&&[^一-鿿]]+')".replace("&&[^一-鿿]", "")
    tokens = lambda t: f"list_concat(list_filter({words.format(t)}, lambda w: NOT regexp_matches(w, '[一-鿿]')), flatten(list_transform(regexp_extract_all({t}, '[一-鿿]+'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"
    brands = listed(WANTED)
    negative = f"regexp_matches(regexp_extract(lower(text), '^(.*)' || lower(b), 1), '(?i){ps.NEGATED_PREFIX}')"
    return f"""aq AS ({asked}), sh AS (SELECT pr.*, CASE WHEN product_id % 4 = 0 THEN coalesce(country, 'CN') WHEN product_id % 4 = 1 THEN 'FR' ELSE country END AS origin FROM pr LEFT JOIN bo2 USING (brand)),
 nb AS (SELECT query_id, b, {negative} AS bad FROM aq, (SELECT unnest({brands}) AS b) WHERE contains(lower(text), lower(b))), ib AS (SELECT query_id, list(b) FILTER (WHERE NOT bad) AS inc, list(b) FILTER (WHERE bad) AS exc FROM nb GROUP BY 1),
 fq AS (SELECT query_id, text, {HIGH} AS high, {first_number(LOW)} AS low, {refused} AS nojp, inc, exc, {way} AS way, {first_number(lx.EN_MIN)} AS floor FROM aq LEFT JOIN ib USING (query_id)),
 dt AS (SELECT product_id, {tokens("concat_ws(' ', title, brand, category, sub_category, substr(description, 1, 400))")} AS terms FROM sh),
 tf AS (SELECT product_id, term, count(*) AS tf, any_value(len(terms)) AS dl FROM (SELECT product_id, terms, unnest(terms) AS term FROM dt) GROUP BY ALL),
 raw AS (SELECT term, ln((s.docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, (SELECT count(*) AS docs FROM dt) s GROUP BY term, s.docs),
 idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
 qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens("text")}) AS term FROM aq) GROUP BY ALL),
 sc AS (SELECT query_id, product_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(terms)) FROM dt)))), 6) AS score FROM tf JOIN idf USING (term) JOIN qt USING (term) GROUP BY ALL),
 ft AS (SELECT sc.* FROM sc JOIN fq USING (query_id) JOIN sh USING (product_id) WHERE (currency != 'CNY' OR ((high IS NULL OR base_price <= high) AND (low IS NULL OR base_price >= low))) AND (inc IS NULL OR list_contains(inc, brand)) AND (exc IS NULL OR len(list_filter(exc, lambda b: contains(lower(brand), lower(b)))) = 0) AND NOT (nojp AND origin IS NOT DISTINCT FROM 'JP') AND ({shelf})),
 t1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rank FROM ft), t2 AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM t1 WHERE rank <= 20 AND score > 0),
 ps AS (SELECT query_id, product_id, rank, n, text, category, title, t2.price, currency, high, low, inc, exc, way, floor, list_distinct({tokens("text")}) AS q, {tokens("concat_ws(' ', title, brand, substr(description, 1, 240))")} AS d, brand,
  n > 1 AND NOT (len(list_filter({brands}, lambda b: regexp_matches(lower(text), '(^|[^a-z])' || lower(b)))) > 0 AND NOT {ANY_CUES}) AS scored FROM (SELECT t2.*, CAST(price_cny AS DOUBLE) AS price FROM t2 JOIN sh USING (product_id)) t2 JOIN fq USING (query_id) JOIN sh USING (product_id)),
 pt AS (SELECT *, CASE WHEN scored THEN CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, d)) / len(q), 6) ELSE 0 END END AS pair FROM ps),
 rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pair DESC NULLS LAST, rank) AS r2 FROM pt),
 rp AS (SELECT * FROM rk WHERE r2 <= CASE WHEN high IS NOT NULL OR low IS NOT NULL THEN 20 WHEN way IS NOT NULL THEN 10 ELSE 5 END),
 ov AS (SELECT query_id, bool_or(len(w) = 0 OR len(list_filter(w, lambda x: contains(lower(concat_ws(' ', title, brand)), x))) > 0) AS overlap FROM (SELECT query_id, title, brand, list_concat(list_filter(regexp_extract_all(lower(text), '[a-z]{{3,}}'), lambda x: x NOT IN ('the', 'and', 'for', 'with')),
  flatten(list_transform(regexp_extract_all(text, '[一-鿿]{{2,}}'), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))) AS w FROM rp WHERE r2 <= 5) GROUP BY 1),
 gt AS (SELECT *, max(pair) OVER (PARTITION BY query_id) AS best FROM rp JOIN ov USING (query_id)),
 rr AS (SELECT * FROM gt WHERE NOT coalesce(best < {gate} AND inc IS NULL AND exc IS NULL AND high IS NULL AND low IS NULL AND NOT overlap, false) AND (high IS NULL OR price <= high) AND (low IS NULL OR price >= low) AND (high IS NOT NULL OR low IS NOT NULL OR floor IS NULL OR coalesce(price >= floor, false))),
 di AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS left_ FROM rr),
 ct AS (SELECT query_id, category AS cat, count(*) AS c, min(r2) AS first FROM di GROUP BY ALL), mn AS (SELECT query_id, cat, c FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, first, cat) AS o FROM ct) WHERE o = 1),
 so AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN way IS NOT NULL AND c >= greatest(3, left_ // 2) AND category != cat THEN 1 ELSE 0 END, CASE WHEN way IS NOT NULL AND price IS NULL THEN 1 ELSE 0 END, CASE way WHEN 'cheap' THEN price WHEN 'expensive' THEN -price END NULLS FIRST, r2, product_id) AS rank FROM di JOIN mn USING (query_id))"""


SHOP = PRICED + f", {ORIGIN}"


@query(SHOP + f", {search_sql(f'SELECT s_suppkey AS query_id, {WISH} AS text FROM supplier')} SELECT query_id, product_id, CAST(rank AS INTEGER) AS rank FROM so WHERE rank <= 5")
def e14_search(spark, sf_dir):
    """Texts with bounds, refused brands and countries, wanted brands."""
    return se.search(wishes(spark, sf_dir), shop(spark, sf_dir), synonyms=lx.SYNONYMS, stop=lx.PRICE_WORDS, brands=WANTED, keep=written, floor=GATE)


#: The catalog on four shelves, with titles that the turns of conversations name.
WORDED = pick("p_size % 3", ("p_name || ' 防晒霜'", "p_name || ' 家居摆件'", "p_name"))
SHELVED = SHOP.replace("p_name AS title", f"{WORDED} AS title").replace("p_type AS category", f"{SHELF} AS category")
CONTEXT = ORACLE["f12_contextual_query"].removeprefix("WITH ")


@query(SHELVED + f", {CONTEXT.replace(' SELECT conv_id, coalesce(query', ', cx AS (SELECT conv_id, coalesce(query')}), jc AS (SELECT DISTINCT conv_id FROM tk WHERE role = 'user' AND contains(text, '不要日系')), " + search_sql("SELECT conv_id AS query_id, query AS text FROM cx", "(contains(text, '不要日系') OR query_id IN (SELECT conv_id FROM jc))", "NOT contains(text, '家居') OR category = '家居家具'", 0.0, f"CASE WHEN contains(text, '便宜') OR {HIGH} IS NOT NULL THEN 'cheap' END") + " SELECT query_id, product_id, CAST(rank AS INTEGER) AS rank FROM so WHERE rank <= 5")
def e14_conversation_search(spark, sf_dir):
    """Products for the last turn of every conversation: its text in context, under what earlier turns asked for and refused."""
    titled = shop(spark, sf_dir).withColumn("title", F.expr(WORDED.replace("p_size", "size").replace("p_name", "title"))).withColumn("category", F.expr(SHELF.replace("p_size", "size")))
    turns = talks(spark, sf_dir)
    users = turns.select("conv_id", F.col("conv_id").alias("user_id")).distinct()
    return se.conversation_search(turns, written(titled), users, WANTED, keep=written)


#: The forms of a text: as it is, without price words, and without exclusions too.
FORMS = f"""w0 AS (SELECT s_suppkey AS id, {WISH} AS text FROM supplier), w1 AS (SELECT *, CASE WHEN trim(regexp_replace(text, '{ps.PRICE_PHRASE}', '', 'g'), ' ,，、的') != '' THEN trim(regexp_replace(text, '{ps.PRICE_PHRASE}', '', 'g'), ' ,，、的') ELSE text END AS plain FROM w0),
 w2 AS (SELECT *, trim(regexp_replace(plain, '{CLAUSE.replace(chr(39), chr(39) * 2)}', '', 'g'), ' ,，、;；的') AS bare FROM w1), w3 AS (SELECT id, 0 AS n, text FROM w0 UNION ALL SELECT id, 1, plain FROM w2 WHERE plain != text UNION ALL SELECT id, 2, bare FROM w2 WHERE bare != '' AND bare != plain)"""


@query(SHOP + f", {FORMS}, {search_sql('SELECT id * 10 + n AS query_id, text FROM w3')}, fo AS (SELECT query_id // 10 AS id, query_id % 10 AS n, product_id, rank, min(query_id % 10) OVER (PARTITION BY query_id // 10) AS first FROM so WHERE rank <= 5), fr AS (SELECT * FROM fo WHERE n = first), em AS (SELECT id, string_agg(CAST(product_id AS VARCHAR), ',' ORDER BY rank) AS emptied FROM fr WHERE n = 2 AND rank <= 3 GROUP BY 1) SELECT w0.id AS query_id, product_id, CAST(rank AS INTEGER) AS rank, CASE WHEN product_id IS NULL THEN 'no_match' WHEN n = 1 THEN 'budget_relaxed' END AS note, emptied FROM w0 LEFT JOIN (SELECT * FROM fr WHERE n < 2) k ON k.id = w0.id LEFT JOIN em ON em.id = w0.id")
def e15_search_relaxed(spark, sf_dir):
    out = se.search_relaxed(wishes(spark, sf_dir), shop(spark, sf_dir), synonyms=lx.SYNONYMS, stop=lx.PRICE_WORDS, brands=WANTED, keep=written, floor=GATE)
    return out.withColumn("emptied", F.array_join(F.transform("emptied", lambda x: x.cast("string")), ","))


@query("SELECT conv_id, turn, trim(CASE WHEN turn % 2 = 0 THEN coalesce(text, '') || chr(10) || role ELSE coalesce(text, '') END, ' ') AS text FROM conversations")
def a5_message_text(spark, sf_dir):
    """Turns as lists of parts: the text, an image, and for even turns a second text."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"), F.lit(None).cast("string").alias("url"))
    parts = F.filter(F.array(part("text", F.col("text")), part("image_url", F.lit("no")), F.when(F.col("turn") % 2 == 0, part("text", F.col("role")))), lambda p: p.isNotNull())
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", cv.message_text(parts).alias("text"))
