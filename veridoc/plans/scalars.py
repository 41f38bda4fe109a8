"""Queries of text, similarity, date, checksum and box functions over the driver's tables, with SQL of their definitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..functions import dates as D
from ..functions import geometry as G
from ..functions import identifiers as I
from ..functions import similarity as S
from ..functions import text as T
from ..operators import classification as K
from ..operators import codes as Q
from ..operators import extraction as E
from . import papers as P
from .registry import query, table

c = F.col


def pick(words: str, i: Column | str) -> Column:
    all_ = words.split(",")
    return F.element_at(F.lit(all_), (F.expr(i) if isinstance(i, str) else i).cast("int") % len(all_) + 1)


def sql_pick(words: str, i: str) -> str:
    all_ = words.split(",")
    return f"([{', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in all_)}])[(({i}) % {len(all_)} + 1)::INT]"


def text_columns(spark: SparkSession, d: str, sql: dict[str, Column], key: str = "p_partkey", of: str = "part") -> DataFrame:
    return table(spark, d, of).select(key, *[v.alias(k) for k, v in sql.items()])


# ---- normal forms ------------------------------------------------------------------------------------------------

_RAW = "p_brand || ' - ' || p_type || '/' || p_name || '.' || p_partkey"
_NORM = f"regexp_replace(lower({_RAW}), '[^a-z0-9]', '', 'g')"


@query(
    f"SELECT p_partkey, {_NORM} AS t1, regexp_replace({_RAW}, '[\\s.\\-]', '', 'g') AS t2, translate(regexp_replace(upper({_RAW}), '[\\s.\\-/]', '', 'g'), 'OQDILZSBG', '000112586') AS t4, "
    f"translate({_NORM}, 'oqdiltjzsbg', '00011112586') AS t5, translate(regexp_replace(upper({_RAW}), '[^A-Z0-9]', '', 'g'), 'ODQILZASGTB', '00011245678') AS t6, "
    f"translate(replace(replace(lower({_RAW}), 'rn', 'm'), 'vv', 'w'), 'eouljthrqy', 'ccciiinngv') AS t7, replace(replace({_RAW}, ' - ', ' – '), '–', '-') AS t9 FROM part"
)
def t1_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    """T1, T2, T4 to T7, T9 and T15."""
    raw = F.concat("p_brand", F.lit(" - "), "p_type", F.lit("/"), "p_name", F.lit("."), c("p_partkey").cast("string"))
    return text_columns(spark, d, {"t1": T.normalized(raw), "t2": T.without_separators(raw), "t4": T.id_form(raw), "t5": T.claim_form(raw), "t6": T.code_form(raw), "t7": T.print_form(raw), "t9": T.plain_dashes(F.replace(raw, F.lit(" - "), F.lit(" – ")))})


@query(
    "SELECT c_custkey, (c_custkey % 28 + 1) || '-' || (c_custkey % 12 + 1) || '-' || CASE WHEN c_custkey % 100 < 50 THEN 2000 + c_custkey % 100 ELSE 1900 + c_custkey % 100 END AS dob, "
    "array_to_string(list_sort(string_split(regexp_replace(lower(c_mktsegment || ' ' || c_name), '[^a-z0-9]', ' ', 'g'), ' ')), ' ') AS name, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS other FROM customer"
)
def t3_normal_value(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    dob = F.concat(P.digits(k % 28 + 1, 2), F.lit("/"), (k % 12 + 1).cast("string"), F.lit("."), P.digits(k % 100, 2))
    of = lambda field, v: T.normal_value(F.lit(field), v)
    return text_columns(spark, d, {"dob": of("DOB", dob), "name": of("NAME", F.concat("c_name", F.lit(", "), "c_mktsegment")), "other": of("PAN", c("c_name"))}, "c_custkey", "customer")


@query("SELECT c_custkey, translate(substr(g, 1, 2), 'OQILTSBZGAH', '00117582649') || translate(substr(g, 3, 5), '0158267', 'OISBZGT') || translate(substr(g, 8, 4), 'OQILTSBZGAH', '00117582649') || translate(substr(g, 12, 1), '0158267', 'OISBZGT') || translate(substr(g, 13, 1), 'OQILTSBZGAH', '00117582649') || translate(substr(g, 14, 1), '0158267', 'OISBZGT') || substr(g, 15) AS folded FROM (SELECT c_custkey, 'O7AA8F' || lpad(c_custkey::VARCHAR, 8, 'S') || 'Z' AS g FROM customer)")
def t8_gstin_form(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("O7AA8F"), F.lpad(c("c_custkey").cast("string"), 8, "S"), F.lit("Z"))
    return text_columns(spark, d, {"folded": T.gstin_form(raw)}, "c_custkey", "customer")


_TITLED = "Mr. ,SHRI ,Dr_,,Md ,M/S "


@query(
    f"SELECT c_custkey, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(n), '[^a-z\\s.]', ' ', 'g'), '[\\s.]+'), lambda x: x <> '' AND x NOT IN ('mr', 'mrs', 'ms', 'shri', 'smt', 'sri', 'thiru', 'dr', 'master', 'kum', 'm/s', 'ms/', 'lt', 'late')), lambda x: CASE WHEN x IN ('md', 'mohd', 'mohammed', 'mohammad', 'mohamed', 'muhammad', 'muhammed') THEN 'mohd' ELSE x END), ' ') AS tokens, "
    f"CASE c_custkey % 6 WHEN 3 THEN n WHEN 4 THEN n ELSE 'Asha K. Rao' END AS bare FROM (SELECT c_custkey, {sql_pick(_TITLED, 'c_custkey')} || 'Asha K. Rao' AS n FROM customer)"
)
def t10_names(spark: SparkSession, d: str) -> DataFrame:
    """T10 and T11."""
    raw = F.concat(pick(_TITLED, "c_custkey"), F.lit("Asha K. Rao"))
    return text_columns(spark, d, {"tokens": F.array_join(T.name_tokens(raw), " "), "bare": T.without_honorific(raw)}, "c_custkey", "customer")


@query("SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all(text || ' ab1cdef don''t', '[A-Za-z]+[0-9''’]?'), lambda x: regexp_full_match(x, '[A-Za-z]{3,}')), ',') AS words FROM conversations")
def t12_word_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.word_candidates(F.concat("text", F.lit(" ab1cdef don't"))), ",").alias("words"))


_PLURALS = "policies,boxes,dealers,class,dishes,name,buzzes"


@query(f"SELECT p_partkey, {sql_pick('policy/policie,box/boxe,dealer,,dish/dishe,,buzz/buzze', 'p_partkey')} AS stems FROM part")
def t13_plural_stems(spark: SparkSession, d: str) -> DataFrame:
    return text_columns(spark, d, {"stems": F.array_join(T.plural_stems(pick(_PLURALS, "p_partkey")), "/")})


_STATES = "MH,JH,ZZ,DL"


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 OR c_custkey % 5 = 0 THEN NULL ELSE {sql_pick(_STATES, 'c_custkey')} || lpad((c_custkey % 9 + 1)::VARCHAR, 2, '0') || 'AB' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') END AS plate FROM customer")
def t14_plate(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    raw = F.concat(F.lower(pick(_STATES, "c_custkey")), F.lit(" O"), (k % 9 + 1).cast("string"), F.when(k % 5 == 0, "").otherwise("-ab "), (k % 10000).cast("string"))
    return text_columns(spark, d, {"plate": T.plate(raw)}, "c_custkey", "customer")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(?:^|[^A-Za-z])licen[cs]e(?:[^A-Za-z]|\\z)') THEN length(regexp_extract(text, '(?is)\\A(.*?)(?:^|[^A-Za-z])(?:licen[cs]e)(?:[^A-Za-z]|\\z)', 1)) ELSE -1 END AS at FROM documents")
def t16_mention(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.mention(c("text"), "licence").cast("long").alias("at"))


_FILES = "PANCARD.pdf,Pankaj_salary.pdf,aadharPan.jpg,taxinvoice.pdf,Japan.png,dl_front.png,Insurance Company.pdf,vehicleInsurance2.pdf"


@query(f"SELECT p_partkey, {sql_pick('true,false,true,false,false,false,false,false', 'p_partkey')} = 'true' AS pan, {sql_pick('false,false,false,true,false,false,false,false', 'p_partkey')} = 'true' AS invoice, {sql_pick('false,false,false,false,false,false,true,true', 'p_partkey')} = 'true' AS insurance FROM part")
def t17_file_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Files by a token of their names; which they have is stated by hand."""
    name = pick(_FILES, "p_partkey")
    return text_columns(spark, d, {"pan": T.file_has_token(name, "pan"), "invoice": T.file_has_token(name, "invoice"), "insurance": T.file_has_token(name, "insurance")})


@query("SELECT conv_id, turn, len(list_filter(regexp_extract_all(text, '[A-Za-z]+[0-9''’]?'), lambda x: regexp_full_match(x, '[A-Za-z]{5,}') AND lower(x) IN ('thement', 'reaution', 'eaution', 'other', 'sentence', 'tionen', 'heren'))) AS score FROM conversations")
def t18_read_score(spark: SparkSession, d: str) -> DataFrame:
    real = F.lit(["thement", "reaution", "eaution", "other", "sentence", "tionen", "heren"])
    return table(spark, d, "conversations").select("conv_id", "turn", T.read_score(T.word_candidates(c("text")), real).cast("long").alias("score"))


@query("SELECT c_custkey, c_custkey % 3 = 0 AS pan, c_custkey % 3 = 1 AND regexp_matches(lpad(c_custkey::VARCHAR, 3, '0'), '^[0-9]{3}$') AS misread, regexp_matches('9' || lpad(c_custkey::VARCHAR, (8 + c_custkey % 2)::INT, '1'), '^9[0-9]{9}$') AS mobile FROM customer")
def t19_shapes(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    three = F.right(F.lpad(k.cast("string"), 3, "3"), F.lit(3))
    raw = F.concat(F.lit("ABCPE3"), F.lpad((k % 4 + 3).cast("string"), 3, "3"), F.lit("F"))
    odd = F.when(k % 3 == 0, raw).when(k % 3 == 1, F.replace(F.concat(F.lit("ABCPE"), F.lit("3O33"), F.lit("F")), F.lit("x"), three)).otherwise(F.concat(raw, F.lit("\n")))
    # three-digit numbers are all that SQL's expectation speaks of
    return text_columns(spark, d, {"pan": T.has_shape(odd, T.SHAPES["PAN"]), "misread": T.misread_shape(odd, T.SHAPES["PAN"]) & F.lpad(k.cast("string"), 3, "0").rlike("^[0-9]{3}$"), "mobile": T.is_mobile(F.concat(F.lit("9"), F.when(k % 2 == 0, F.lpad(k.cast("string"), 8, "1")).otherwise(F.lpad(k.cast("string"), 9, "1"))))}, "c_custkey", "customer")


@query("""SELECT page_id, regexp_replace(regexp_replace(html, '(?i)\\b(src|href|action)=(["''])/([^/])', '\\1=\\2/p/\\3', 'g'), '(?i)url\\((["'']?)/([^/])', 'url(\\1/p/\\2', 'g') AS html, array_to_string(list_slice(string_split(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '.'), -2, -1), '.') AS domain, rtrim(translate(to_base64(encode(url)), '+/', '-_'), '=') AS token FROM pages""")
def t20_web(spark: SparkSession, d: str) -> DataFrame:
    """T20 to T22."""
    return table(spark, d, "pages").select("page_id", T.rewritten_links(c("html"), "/p").alias("html"), T.registrable_domain(c("url")).alias("domain"), T.url_token(c("url")).alias("token"))


@query("SELECT c_custkey, c_custkey % 3 > 0 AS valid, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'New India ' || c_custkey END AS insurer FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT c_custkey, false, '' FROM customer WHERE c_custkey % 4 = 0")
def s15_record_page(spark: SparkSession, d: str) -> DataFrame:
    k = c("c_custkey")
    html = F.concat(F.lit('<p><span id="lblmsg">'), F.when(k % 3 == 0, "Invalid Data").otherwise(""), F.lit("</span><SPAN class=x id='lblIC'> "), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("New <b>India</b> "), k.cast("string"))), F.lit("</span></p>"))
    rows = table(spark, d, "customer").select("c_custkey", *Q.online_record(html))
    return rows.select("c_custkey", "valid", "insurer")


@query("SELECT p_partkey, " + sql_pick("application/pdf,image/jpeg,application/octet-stream,image/png", "p_partkey") + " AS mime, CASE p_partkey % 5 WHEN 0 THEN '''=1+1' WHEN 1 THEN '''-5' WHEN 2 THEN 'x=1' WHEN 3 THEN '''@a' ELSE '''+b' END AS cell FROM part")
def s18_mime_s22_guard(spark: SparkSession, d: str) -> DataFrame:
    return text_columns(spark, d, {"mime": T.mime_type(pick("a.pdf,b.x.JPG,noext,c.png", "p_partkey")), "cell": T.guarded(pick("=1+1,-5,x=1,@a,+b", "p_partkey"))})


# ---- similarity --------------------------------------------------------------------------------------------------

_WORDS = "signature,designation,department,company,allowance"
_EDITED = "CASE p_partkey % 6 WHEN 0 THEN w WHEN 1 THEN substr(w, 1, 2) || substr(w, 4, 1) || substr(w, 3, 1) || substr(w, 5) WHEN 2 THEN substr(w, 1, 3) || substr(w, 5) WHEN 3 THEN 'x' || w WHEN 4 THEN substr(w, 1, 2) || 'q' || substr(w, 4, 2) || 'z' || substr(w, 7) ELSE 'zzz' || substr(w, 4) || 'zzz' END"


def edited(spark: SparkSession, d: str) -> DataFrame:
    """Words w and v, which is w after none, one, two or more edits."""
    return table(spark, d, "part").select("p_partkey", pick(_WORDS, F.floor(c("p_partkey") / 6)).alias("w")).withColumn("v", F.expr(_EDITED))


@query(f"SELECT p_partkey, least(damerau_levenshtein(w, v), 3)::INT AS osa, levenshtein(w, v) <= 1 AS m2, levenshtein(w, v) <= 2 AS m3 FROM (SELECT *, {_EDITED} AS v FROM (SELECT p_partkey, {sql_pick(_WORDS, 'p_partkey // 6')} AS w FROM part))")
def m1_edit_distances(spark: SparkSession, d: str) -> DataFrame:
    """M1 to M3."""
    w, v = c("w"), c("v")
    return edited(spark, d).select("p_partkey", S.edit_distance(w, v, 2).alias("osa"), S.within_edits(w, v).alias("m2"), S.within_edits(w, v, 2).alias("m3"))


_PAIRS = "asha rao|Rao Asha,asha rao|A. Rao,asha rao|Lata Rao,asha rao|Asha Rao Kumar,saikiran rao|Rao Sai Kiran,asha rao|,ramesh shah|Suresh Shah,harisunder|Hari Sunder Mishra,rameshkumar|SURESH RAMESH GUPTA,md ali|Mr Mohammed Ali,kumar das|Kumari Das,rajesh soni|Rajesh Son"


@query(f"SELECT c_custkey, {sql_pick('1,1,0,1,1,1,0,1,0,1,1,1', 'c_custkey')} = '1' AS same FROM customer")
def m4_names(spark: SparkSession, d: str) -> DataFrame:
    """Names whose agreement is stated by hand."""
    pair = F.split(pick(_PAIRS, "c_custkey"), r"\|")
    return text_columns(spark, d, {"same": S.same_name(pair[0], pair[1])}, "c_custkey", "customer")


def _sql_id(x: str) -> str:
    return f"translate(regexp_replace(upper({x}), '[\\s.\\-/]', '', 'g'), 'OQDILZSBG', '000112586')"


@query(
    f"SELECT p_partkey, levenshtein({_sql_id('a')}, {_sql_id('b')}) <= 1 AS m5, list_has_all(x, y) OR list_has_all(y, x) AS m6 FROM (SELECT *, string_split(lower(p_name || ' ' || p_type), ' ') AS x, string_split(lower(p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' big' END), ' ') AS y, "
    "'AB-' || p_partkey || 'O1' AS a, CASE p_partkey % 3 WHEN 0 THEN 'ab ' || p_partkey || '01' WHEN 1 THEN 'AB' || p_partkey || '1' ELSE 'XB' || (p_partkey + 11) || '0I' END AS b FROM part)"
)
def m5_ids_and_models(spark: SparkSession, d: str) -> DataFrame:
    """M5 and M6."""
    n = c("p_partkey").cast("string")
    a = F.concat(F.lit("AB-"), n, F.lit("O1"))
    b = F.when(c("p_partkey") % 3 == 0, F.concat(F.lit("ab "), n, F.lit("01"))).when(c("p_partkey") % 3 == 1, F.concat(F.lit("AB"), n, F.lit("1"))).otherwise(F.concat(F.lit("XB"), (c("p_partkey") + 11).cast("string"), F.lit("0I")))
    return text_columns(spark, d, {"m5": S.same_id(a, b), "m6": S.same_model(F.concat_ws(" ", "p_name", "p_type"), F.concat("p_name", F.when(c("p_partkey") % 2 == 0, "").otherwise(" big")))})


_ADDRESSES = "12 MG Road Shivaji Park Pune 411001|MG Rd. 12; Shivaji Park. Pune - 411001,Shivaji Park Pune 411001|Shivaji Park Pune 411002,Tilak Chowk Nashik|Gandhi Chowk Nagpur,House No 5|Flat 7,Lal Bagh Market Hazratganj|Lal Bagh Hazratganj Lucknow"


@query(f"SELECT c_custkey, {sql_pick('1,0,0,1,1', 'c_custkey')} = '1' AS m7, c_custkey % 3 <> 1 AS m8, {sql_pick('1,0,1,1', 'c_custkey')} = '1' AS m10, {sql_pick('1,0,1', 'c_custkey')} = '1' AS m12 FROM customer")
def m7_addresses_dates_genders_insurers(spark: SparkSession, d: str) -> DataFrame:
    """M7, M8, M10 and M12, whose agreement is stated by hand."""
    k = c("c_custkey")
    pair = lambda words: F.split(pick(words, "c_custkey"), r"\|")
    a, g, i = pair(_ADDRESSES), pair("M|MALE,F|male,|F,Female|F"), pair("Reliance General Insurance|IndusInd General,New India Assurance|United India,Bajaj Allianz|Bajaj General Insurance Co")
    date = F.when(k % 3 == 0, "5-11-94").when(k % 3 == 1, "06/11/1994").otherwise("not a date")
    return text_columns(spark, d, {"m7": S.same_address(a[0], a[1]), "m8": S.same_day(F.lit("05/11/1994"), date), "m10": S.same_gender(g[0], g[1]), "m12": S.same_insurer(i[0], i[1])}, "c_custkey", "customer")


_CARS = "WVE1RTY2UKP000123|WVE1RTY2UKP000123,WVE1RTY2UKP000123|WVEIRTY2UKPO00123,WVE1RTY2UKP000123|ABC1RTY2UKP999999,000123|WVE1RTY2UKP000123,12|WVE1RTY2UKP000123"


@query(f"SELECT c_custkey, {sql_pick('1,1,0,1,0', 'c_custkey')} = '1' AS m11, {sql_pick('1,1,0,0,0', 'c_custkey')} = '1' AS m9, {sql_pick('1,1,0', 'c_custkey')} = '1' AS m18 FROM customer")
def m9_vehicles(spark: SparkSession, d: str) -> DataFrame:
    """M9, M11 and M18, whose agreement is stated by hand."""
    pair = lambda words: F.split(pick(words, "c_custkey"), r"\|")
    a, b = pair(_CARS), pair("ABCPE1234F|ABCPE1234G,1234|ABCPE1234F,ABCPE1234F|ABCPX9934G")
    return text_columns(spark, d, {"m11": S.same_chassis(a[0], a[1]), "m9": S.same_identifier(a[0], a[1]), "m18": S.near_layer(b[0], b[1])}, "c_custkey", "customer")


@query(
    "SELECT c_custkey, c_custkey % 4 = 0 AS exact, CASE c_custkey % 4 WHEN 1 THEN 'WVEIR7Y2UKP' || lpad(c_custkey::VARCHAR, 6, '0') WHEN 0 THEN 'WVE1RTY2UKP' || lpad(c_custkey::VARCHAR, 6, '0') END AS misread, (c_custkey % 3 = 0) AS short FROM customer"
)
def m13_claim_ids(spark: SparkSession, d: str) -> DataFrame:
    """M13 and M14."""
    k = c("c_custkey")
    tail = P.digits(k, 6)
    printed = F.when(k % 4 == 0, F.concat(F.lit("no wve-1rty2 ukp"), tail)).when(k % 4 == 1, F.concat(F.lit("x WVEIR7Y2UKP"), tail, F.lit(" y"))).when(k % 4 == 2, F.concat(F.lit("WVE1RTY2UKP"), P.digits(k + 1, 6))).otherwise("none")
    return text_columns(spark, d, {"exact": S.has_claim_id(printed, P.vin(k)), "misread": S.misread_claim_id(printed, P.vin(k)), "short": S.has_claim_id(F.when(k % 3 == 0, "ref 001.").otherwise("Invoice 2001"), F.lit("001"))}, "c_custkey", "customer")


_NEAR = "signatu|signature,novernber|november,retantion|retention,profesion|profession,oesignation|designation,degination|designation"


@query(f"SELECT p_partkey, {sql_pick('1,1,0,0,1,1', 'p_partkey')} = '1' AS m16, {sql_pick('0,0,1,1,0,1', 'p_partkey')} = '1' AS m17, {sql_pick('1,0,0,0,0,0', 'p_partkey')} = '1' AS cut, {sql_pick('0,1,0,0,0,0', 'p_partkey')} = '1' AS glyphs FROM part")
def m16_doubt(spark: SparkSession, d: str) -> DataFrame:
    """What a scan explains, stated by hand."""
    p = F.split(pick(_NEAR, "p_partkey"), r"\|")
    a, b = p[0], p[1]
    return text_columns(spark, d, {"m16": S.is_doubtful(a, b, S.edit_distance(a, b, 2)), "m17": S.near_form_word(a, b, F.lit(False)), "cut": S.clipped(a, b), "glyphs": S.same_print(a, b)})


@query(f"SELECT p_partkey, {sql_pick('1,0,0,1,0', 'p_partkey')} = '1' AS m15 FROM part")
def m15_misread_shapes(spark: SparkSession, d: str) -> DataFrame:
    return text_columns(spark, d, {"m15": T.misread_shape(pick("ABCPE12O4F,ABCPE1234F,ABCPEXXXXF,A8CPEI234F,ABCPE1234", "p_partkey"), T.SHAPES["PAN"])})


# ---- dates -------------------------------------------------------------------------------------------------------


@query(
    "SELECT o_orderkey, (o_orderkey % 100 < 50)::INT * 100 + 1900 + o_orderkey % 100 AS d1, try_strptime(lpad((o_orderkey % 33)::VARCHAR, 2, '0') || '/' || lpad((o_orderkey % 14)::VARCHAR, 2, '0') || '/' || (1999 + o_orderkey % 3), '%d/%m/%Y') IS NOT NULL AS d2, "
    "epoch_ms(date_trunc('day', o_orderdate)) + 86399999 AS d6, CASE o_orderkey % 3 WHEN 0 THEN '2024-01-02 03:04:05 +05:30' WHEN 1 THEN '2024-01-02 03:04:05 UTC' ELSE 'scanned' END AS d7, CASE o_orderkey % 4 WHEN 0 THEN '05.06.2021' WHEN 1 THEN '1-2-1999' END AS d8 FROM orders"
)
def d1_dates(spark: SparkSession, d: str) -> DataFrame:
    """D1, D2, D6, D7 and D8."""
    k = c("o_orderkey")
    pdf = F.when(k % 3 == 0, "D:20240102030405+05'30'").when(k % 3 == 1, "D:20240102030405Z").otherwise("scanned")
    text = F.when(k % 4 == 0, "x 99/99/2020 then 05.06.2021").when(k % 4 == 1, "on 1-2-1999, 2-2-2000").when(k % 4 == 2, "13/14/2020").otherwise("none")
    return table(spark, d, "orders").select("o_orderkey", D.full_year(k % 100).alias("d1"), D.is_day(k % 33, k % 14, 1999 + k % 3).alias("d2"), F.unix_millis(D.whole_day_end(c("o_orderdate"))).alias("d6"), D.pdf_date(pdf).alias("d7"), D.first_date(text).alias("d8"))


_DATES = "31/02/2024|31/02/2024,29/02/2023 and 28/02/2023|29/02/2023,6/29/26|,32/01/21|32/01/21,LWP 0.00/0.00|,+91-20-2721 8080|,Joining Date: 32-13-20000|32-13-20000,17-57-00|,DOB: 99/02/24|99/02/24,Dt.31/04/2024|31/04/2024,Policy No: 20/20/20012|,11.12.20000|11.12.20000"


@query(f"SELECT p_partkey, {sql_pick(','.join(x.split('|')[1] for x in _DATES.split(',')), 'p_partkey')} AS bad FROM part")
def d3_impossible_dates(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose impossible dates are stated by hand."""
    text = F.split(pick(_DATES, "p_partkey"), r"\|")[0]
    return text_columns(spark, d, {"bad": F.array_join(D.impossible_dates(text), ",")})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 200 - 100 > 60 THEN 'REDFLAG_MODIFIED_AFTER_CREATE' WHEN o_orderkey % 200 - 100 < -60 THEN 'REDFLAG_TIMESTAMP_ORDER' END AS code FROM orders")
def d4_stamps(spark: SparkSession, d: str) -> DataFrame:
    k = c("o_orderkey")
    created = F.lit("2024-01-02 03:04:05 +05:30")
    seconds = F.unix_timestamp(F.lit("2024-01-01 21:34:05")) + k % 200 - 100
    modified = F.when(k % 5 == 0, "unknown").otherwise(F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))
    return table(spark, d, "orders").select("o_orderkey", D.stamp_code(created, modified).alias("code"))


# ---- checksums and codecs ----------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_custkey % 9 <> 2 AS c1, c_custkey % 4 > 0 AS c2, (" + " + ".join(f"substr(lpad(c_custkey::VARCHAR, 12, '4'), {i + 1}, 1)::INT * {[7, 3, 1][i % 3]}" for i in range(12)) + ") % 10 AS c3 FROM customer")
def c1_checks(spark: SparkSession, d: str) -> DataFrame:
    """Numbers with a right check character, but for planted ones."""
    rows = P.claims(spark, d)
    last = F.when(F.substring("gstin", 15, 1) == "A", "B").otherwise("A")
    gstin = F.when(c("k") % 4 == 0, F.concat(F.substring("gstin", 1, 14), last)).otherwise(c("gstin"))
    return rows.select(c("k").alias("c_custkey"), I.verhoeff_ok(c("uid")).alias("c1"), I.gstin_ok(gstin).alias("c2"), I.mrz_digit(F.lpad(c("k").cast("string"), 12, "4")).alias("c3"))


@query("SELECT c_custkey, chr((65 + c_custkey % 8)::INT) || lpad((1000000 + c_custkey)::VARCHAR, 7, '0') AS number, (c_custkey % 3 = 0)::INT AS folds, CASE WHEN c_custkey % 25 = 10 THEN 'whole line' ELSE '' END AS failed FROM customer")
def c4_zone(spark: SparkSession, d: str) -> DataFrame:
    """Lines with planted wrong digits, and with a letter O for a zero in every third."""
    rows = P.claims(spark, d)
    noisy = F.when(c("k") % 3 == 0, F.concat(F.substring("mrz", 1, 15), F.replace(F.substring("mrz", 16, 1), F.lit("0"), F.lit("O")), F.substring("mrz", 17, 60))).otherwise(c("mrz"))
    m = I.mrz(F.concat(F.lit(" "), noisy))
    out = rows.select(c("k").alias("c_custkey"), m.alias("m"))
    return out.select("c_custkey", F.substring("m.data", 1, 8).alias("number"), "m.folds", F.array_join(I.mrz_failures(c("m")), ",").alias("failed"))


@pandas_udf(StringType())
def secure_codes(keys: pd.Series) -> pd.Series:
    """Codes that a printer would make, of numbered people; every third has a version before its fields."""

    def one(i: int) -> str:
        fields = [*(["V2"] if i % 3 == 0 else []), "3", f"ref{i}", f"Asha {i}", "05-11-1994", "FM"[i % 2], *[""] * 5, "411001", *[""] * 5]
        return Q.secure_payload([*fields, "photo" * 60 + "".join(chr(33 + (i * 13 + j * j * 7) % 90) for j in range(400))])

    return keys.map(one)


@query("SELECT c_custkey AS k, 'Name:Asha ' || c_custkey || '|DOB:05-11-1994|Gender:' || CASE WHEN c_custkey % 2 = 0 THEN 'FEMALE' ELSE 'MALE' END || '|PIN:411001|Reference Id:ref' || c_custkey AS fields FROM customer")
def c5_secure_codes(spark: SparkSession, d: str) -> DataFrame:
    """A round trip of each customer's code, with and without a version before it."""
    rows = table(spark, d, "customer").select(c("c_custkey").alias("k")).withColumn("value", secure_codes(c("k")))
    return rows.select("k", Q.readable(c("value")).alias("fields"))


_PAYLOADS = ["Name:Asha Rao|PolNo:12-3|Time:1:30PM", "<x uid=\"12\" name=\"Asha\"/>", "GSTIN:27A\nLegal Name: A, B\nGSTIN:other", "invoiceno:7,amount: 5", "plain text"]
_PARSED = ["name=Asha Rao;polno=12-3;time=1:30PM", "uid=12;name=Asha", "gstin=27A;legalname=A, B", "invoiceno=7;amount=5", ""]


@query("SELECT p_partkey, ([" + ", ".join(f"'{x}'" for x in _PARSED) + "])[(p_partkey % 5 + 1)::INT] AS parsed, CASE WHEN p_partkey % 5 = 4 THEN 'binary:AP8=' ELSE 'text' END AS shown FROM part")
def c6_payloads(spark: SparkSession, d: str) -> DataFrame:
    """C6 and C7."""
    k = c("p_partkey")
    value = F.element_at(F.lit(_PAYLOADS), (k % 5).cast("int") + 1)
    raw = F.when(k % 5 == 4, F.unhex(F.lit("00FF"))).otherwise(F.lit("text").cast("binary"))
    return text_columns(spark, d, {"parsed": F.array_join(F.transform(Q.payload(value), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), "shown": Q.shown_value(raw)})


# ---- boxes -------------------------------------------------------------------------------------------------------


@query(
    "SELECT l_orderkey, l_linenumber, round(CASE (l_linenumber % 4) WHEN 1 THEN 1 - l_tax - 0.2 WHEN 2 THEN 1 - l_discount - 0.1 WHEN 3 THEN l_tax ELSE l_discount END, 9) AS x, round(CASE (l_linenumber % 4) WHEN 1 THEN l_discount WHEN 2 THEN 1 - l_tax - 0.2 WHEN 3 THEN 1 - l_discount - 0.1 ELSE l_tax END, 9) AS y, "
    "round(CASE WHEN l_linenumber % 2 = 1 THEN 0.2 ELSE 0.1 END, 9) AS w, round(least(1, l_quantity / 40) - 0.0, 9) AS clamped FROM lineitem"
)
def g1_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = G.box(c("l_discount"), c("l_tax"), F.lit(0.1), F.lit(0.2))
    turned = G.unrotated(box, (c("l_linenumber") % 4) * 90)
    whole = G.rotated(G.unrotated(turned, F.lit(90)), F.lit(90))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(whole["x"], 9).alias("x"), F.round(whole["y"], 9).alias("y"), F.round(whole["w"], 9).alias("w"), F.round(G.clipped(G.box(F.lit(0.0), F.lit(0.0), c("l_quantity") / 40, F.lit(1.0)))["w"], 9).alias("clamped"))


@query("SELECT conv_id, turn, len(regexp_extract_all(text, '[^ ]+')) >= 3 AS found FROM conversations WHERE len(regexp_extract_all(text, '[^ ]+')) >= 3 AND length(regexp_replace(lower((regexp_extract_all(text, '[^ ]+'))[2]), '[^a-z0-9]', '', 'g')) > 0")
def g2_located(spark: SparkSession, d: str) -> DataFrame:
    """The second and third words of each turn are found as one run, from the second on or before it."""
    rows = table(spark, d, "conversations").select(c("conv_id").alias("document"), c("turn").alias("page"), F.array_remove(F.split("text", " "), "").alias("all"))
    words = rows.select("document", "page", F.posexplode("all").alias("k", "text")).select("*", (c("k") / 100).alias("x"), F.lit(0.5).alias("y"), F.lit(0.01).alias("w"), F.lit(0.02).alias("h"))
    values = rows.where(F.size("all") >= 3).where(T.normalized(F.get("all", F.lit(1))) != "").select("document", "page", F.concat(F.get("all", F.lit(1)), F.lit(" "), F.get("all", F.lit(2))).alias("value"))
    found = G.located(words, values)
    return found.select(c("document").alias("conv_id"), c("page").alias("turn"), (c("box.x") <= 0.01 + 1e-9).alias("found"))


@query("SELECT p_partkey, round(least(greatest(2, 1400 / (p_size * 20.0)), 8192 / (p_size * 20.0)), 6) AS scale, p_size > 10 AND (p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND p_size > 20)) AS again FROM part")
def g6_scales(spark: SparkSession, d: str) -> DataFrame:
    side = c("p_size") * 20.0
    again = G.reread_adds(c("p_size"), F.when(c("p_partkey") % 3 == 1, c("p_size") - 10), c("p_partkey") % 3 < 2, F.lit(10))
    return text_columns(spark, d, {"scale": F.round(G.raster_scale(side, side / 2, 2.0, 1400.0), 6), "again": again})


# ---- classification of texts that are stated -----------------------------------------------------------------------

_PAGES = {
    "UIDAI help": ("AADHAR", None), "DOB: 1/1/1990 MALE 2345 6789 0123": ("AADHAR", None), "MALE Toll Free 1800 2345 6789": (None, None), "INCOMETAX DEPARTMENT": ("PAN", None), "Permanent Account Number of the dealer, Tax Invoice No 5": (None, "INVOICE"),
    "driving licence LMV": ("DL", None), "holds an effective driving license": (None, None), "Election Commission of India": ("VOTER_ID", None), "P<INDRAO<<ASHA": ("PASSPORT", None), "P K INDIRA": (None, None), "GSTIN 27A": ("GST", None), "MSME UDYAM": ("UDYAM", None),
    "Pay Slip Employee No 5": (None, "PAYSLIP"), "Staff No. 5": (None, "STAFF_ID"), "Elector Photo Identity Card": (None, None), "Insured: X Premium 5": (None, "INSURANCE"), "Regn. No. 5 Registering Authority": (None, "RC"), "dear sir": (None, None),
}


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


_CARD, _BUSINESS = [x or "" for x, _ in _PAGES.values()], [x or "" for _, x in _PAGES.values()]


@query(f"SELECT p_partkey, nullif(card, '') AS card, nullif(business, '') AS business, CASE WHEN business <> '' THEN business WHEN card <> '' THEN 'KYC' ELSE 'UNKNOWN' END AS type FROM (SELECT p_partkey, {sql_pick(','.join(_CARD), 'p_partkey')} AS card, {sql_pick(','.join(_BUSINESS), 'p_partkey')} AS business FROM part)")
def k1_page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """K1 to K3 on texts whose kinds are stated by hand, one for each part."""
    text = P.pick(list(_PAGES), c("p_partkey"))
    return text_columns(spark, d, {"card": K.card(text), "business": K.business_type(text), "type": K.page_type(text)})


_SOFT = "Midjourney v5|image/png||,scanner|image/jpeg||,scanner|image/jpeg|Canon|R5,|application/pdf||"


@query(f"SELECT p_partkey, {sql_pick('software: Midjourney v5,no camera make/model on a JPEG,,', 'p_partkey')} AS signals, CASE p_partkey % 4 WHEN 0 THEN 'pan' WHEN 1 THEN NULL WHEN 2 THEN 'pan' ELSE 'inv' END AS file_type, CASE p_partkey % 3 WHEN 0 THEN 'Invoice' WHEN 1 THEN 'Bill' END AS named, CASE WHEN p_partkey % 7 = 0 THEN 'MISMATCH' WHEN p_partkey % 5 = 0 THEN 'UNREADABLE' WHEN p_partkey % 2 = 0 THEN 'NO_QR' ELSE 'OK' END AS outcome FROM part")
def k5_kinds_by_name(spark: SparkSession, d: str) -> DataFrame:
    """K5 to K8."""
    k = c("p_partkey")
    meta = F.split(pick(_SOFT, "p_partkey"), r"\|")
    types = [{"id": "pan", "name": "PAN Card", "code": "PAN", "order": 1}, {"id": "inv", "name": "Invoice", "code": None, "order": 2}]
    text = F.when(k % 3 == 0, "Bill To: x. Tax invoice").when(k % 3 == 1, "a bill, an invoice").otherwise("billing")
    lit = lambda x: F.lit(x).cast("string")
    return text_columns(spark, d, {
        "signals": F.array_join(K.ai_signals(meta[0], lit(None), lit(None), meta[2], meta[3], meta[1]), ";"), "file_type": K.file_type(pick(",".join(_FILES.split(",")[:4]), "p_partkey"), types),
        "named": K.named_type(text, ["Bill", "Invoice"], F.when(k % 3 == 0, "INVOICE").otherwise("")), "outcome": K.qr_outcome(F.when(k % 7 == 0, 1).otherwise(0), F.when(k % 5 == 0, 1).otherwise(0), k % 2, F.lit(1)),
    })


_LINES = "pvt = Private,LTD - Limited,no separator here,,a: b,uan: Universal Account Number"


@query(f"SELECT p_partkey, {sql_pick('pvt,ltd,,,a,uan', 'p_partkey')} AS term, {sql_pick('Private,Limited,,,b,Universal Account Number', 'p_partkey')} AS expansion, nullif({sql_pick(',,no separator,empty,too short,', 'p_partkey')}, '') AS problem FROM part")
def e16_glossary_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(c("p_partkey").alias("n"), pick(_LINES, "p_partkey").alias("line"))
    return E.glossary_lines(rows).select(c("n").alias("p_partkey"), "term", "expansion", "problem")
