"""PII surrogates: keyed, type-consistent replacements.

Entities are e-mail and IP addresses, phone numbers, card and account numbers,
IBANs, social security numbers, and names.  A name is found after a form of
address (before it in Chinese); from then on every capitalised word of that
text which is a part of such a name is replaced, with a title or without one.
A number's canonical form (lower-case address, digits, for phones with ``+`` if
written) and every part of a name (lower case) get a surrogate from a keyed
hash: same type, same number of digits, the first digit or the country code
kept, valid check digits kept valid, names of the same script (Latin, Cyrillic,
Greek, Han; all others as Latin).  Parts of names map one by one, so "John
Smith", "Dr Smith" and "Smith" stay one person everywhere.  A part has the
gender of its titles in the whole corpus, and none if they differ.  The surrogate
is written in the original's format.

Surrogates are checked over the whole corpus: if two canonical forms of a type
get the same one, or one equals a real entity, all but the smallest form (or
the form itself) try again, until none is left; distinct stays distinct.  Names
get two more syllables with every attempt.  Where the real numbers of one type,
length and first digit (or country code) are so many that tries would often
fail, the numbers of that space are put in a keyed order and the real ones take
the free ones by rank.  If over half of a space is real there are too few free
ones: each real number then takes the next of the whole space in that order, so
that distinct stays distinct and none stays as it is, but one may be another
real number.

The key is the argument ``key``, else the session's ``tallyscope.surrogate.key``.

Everything is built-in SQL functions.  Null texts stay null; rows without an
entity are unchanged; repeated rows get equal results; columns named as the
operator's own are not touched, since helper columns are prefixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.rows import literal_rows, materialize
from tallyscope.llm.common import packed, unpacked

#: Used where neither the caller nor the session gives a key.
KEY, KEY_SETTING = "tallyscope surrogate key", "tallyscope.surrogate.key"
#: Attempts after which a still unresolved collision is an error.
MOST_ATTEMPTS = 50
#: Spaces of numbers with a greater share of real ones are dealt out by rank.
MOST_LOAD = 1 / 8

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}.-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![\p{L}\p{N}-])"
PHONE = (r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2,5}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}"
         r"|(?=(?:[0-9][ -]?){10,11}(?![ -]?[0-9]))0[1-9][0-9]{1,3}[ -][0-9]{3,8}(?:[ -][0-9]{3,6})?)(?![\p{L}\p{N}])")
#: Country codes by their first digits: one digit, two digits, else three.
COUNTRY = "[+](?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
MALE, FEMALE = "Mr|Herrn?|Sr|Señor|Monsieur|господин|г-н|[Κκ]ύριος", "Mrs|Ms|Miss|Frau|Mme|Mlle|Sra|Srta|Señora|Madame|госпожа|г-жа|[Κκ]υρία"
TITLES = rf"(?:(?:{MALE}|{FEMALE}|Dr|Prof)\.? )++"
#: A capitalised word, as parts of names are.
PART = r"(?:\p{Lu}['’])?\p{Lu}[\p{L}\p{M}]++"
# Frequent Chinese family names, and forms of address that follow a name.
FAMILY_NAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩邓冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔"
MALE_AFTER, FEMALE_AFTER, OTHER_AFTER = "先生", "女士|小姐", "教授|博士"
AFTER = f"{MALE_AFTER}|{FEMALE_AFTER}|{OTHER_AFTER}"
#: The range of Chinese characters is tested before the family names one by one.
HAN_PART = rf"(?=[\u4E00-\u9FFF])[{FAMILY_NAMES}]\p{{IsHan}}{{0,2}}?(?=(?:{AFTER}))"
#: First letters of all titles, a cheap test before the lookbehind.
_TITLE_LETTER = "(?=[DFHMPSгΚκ])"
NAME = rf"{_TITLE_LETTER}(?<![\p{{L}}\p{{M}}\p{{N}}]){TITLES}(?:\p{{Lu}}\. )*{PART}(?:[ -](?:\p{{Lu}}\. )?{PART})?|{HAN_PART}(?:{AFTER})"
KINDS = (("email", EMAIL), ("ip", IP), ("iban", IBAN), ("ssn", SSN), ("card", CARD), ("phone", PHONE))
#: Entities by their form alone, and with all that may be part of a name.
_FORMS = dict(KINDS)
NUMBER = f"(?:{EMAIL})|(?=[0-9+(])(?:{'|'.join(f'(?:{_FORMS[k]})' for k in ('ip', 'ssn', 'card', 'phone'))})|(?=[A-Z][A-Z][0-9])(?:{IBAN})"
PIECE = rf"{NUMBER}|(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}\p{{N}}]){PART}|{HAN_PART}"
#: Cheap tests that every number and every name passes.
NUMBER_HINT = "[@0-9]"
NAME_HINT = rf"(?:[rnueosavtςα]|Dr|Prof|ss|н|а)\.? \p{{Lu}}|{AFTER}"

# Syllables of made-up names by script; endings by gender.
LATIN = ("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "ko", "du", "ra")
GREEK = ("βα", "κε", "δι", "φο", "γου", "λα", "με", "νι", "πο", "ρο", "σα", "τε", "βι", "κο", "δου", "ρα")
HAN = ("安", "柏", "晨", "东", "恩", "凡", "光", "海", "佳", "凯", "兰", "明", "宁", "平", "清", "瑞")
CYRILLIC = ("ба", "ве", "ди", "фо", "гу", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "ко", "ду", "ра")


def kind_of(match: Column) -> Column:
    """Type of a match that is no name, by its form."""
    out = F.when(match.contains("@"), "email").when(match.rlike(r"^[0-9.]+$") & match.rlike(f"^{IP}$"), "ip").when(match.rlike(f"^{SSN}$"), "ssn")
    return out.when(match.rlike(f"^{IBAN}$"), "iban").when(match.rlike(f"^(?:{CARD})$"), "card").otherwise("phone")


def canonical(kind: Column, match: Column) -> Column:
    """The form under which spellings of one entity are equal."""
    digits = F.concat(F.when((kind == "phone") & match.startswith("+"), "+").otherwise(""), F.regexp_replace(match, "[^0-9]", ""))
    return F.when(kind == "email", F.lower(match)).when(kind == "ip", match).when(kind == "name", F.lower(match)).when(
        kind == "iban", F.upper(F.regexp_replace(match, "[^A-Za-z0-9]", ""))).otherwise(digits)


def name_parts(match: Column) -> Column:
    """The parts of a name as written, without forms of address and initials."""
    bare = F.regexp_replace(match, rf"^{TITLES}|(?:{AFTER})$|(?<=[ -])\p{{Lu}}\. ", "")
    return F.split(bare, "[ -]")


def gender(match: Column) -> Column:
    """``m`` or ``f`` by a form of address, null if it tells neither."""
    before = r"^(?:\S+ )*?(?:{})\.? "
    return F.when(match.rlike(before.format(FEMALE) + f"|(?:{FEMALE_AFTER})$"), "f").when(match.rlike(before.format(MALE) + f"|(?:{MALE_AFTER})$"), "m")


def _luhn(digits: str) -> str:
    """SQL: Luhn sum of a string of digits whose last digit is the check digit."""
    return (f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> CASE WHEN i % 2 = 1 THEN CAST(d AS INT) * 2 - IF(CAST(d AS INT) > 4, 9, 0) ELSE CAST(d AS INT) END), 0, (a, d) -> a + d)")


#: SQL: what a surrogate of a number keeps at its start.
_HEAD = f"IF(canon LIKE '+%', regexp_extract(canon, '^{COUNTRY}', 0), left(canon, 1))"


def surrogate(key: str) -> str:
    """SQL: surrogate of the columns ``kind, canon, attempt``, in canonical form."""
    secret = key.replace("\\", "\\\\").replace("'", "\\'")
    inner = f"sha2(concat('{secret}', kind, ':', canon, ':', attempt), 256)"
    hex_ = f"sha2(concat('{secret}', {inner}), 256)"
    digits = f"translate({hex_}, 'abcdef', '035791')"
    letters = f"translate({hex_}, '0123456789', 'ghijkmnpqr')"
    keep_one = f"concat({_HEAD}, substr({digits}, 1, length(canon) - length({_HEAD})))"
    body = f"concat(left(canon, 1), substr({digits}, 1, length(canon) - 2))"
    check = f"CAST((10 - {_luhn(f'concat({body}, 0)')} % 10) % 10 AS STRING)"
    octet = lambda i: f"CAST(1 + CAST(conv(substr({hex_}, {4 * i + 1}, 4), 16, 10) AS INT) % 254 AS STRING)"
    table = lambda s: f"array({', '.join(repr(x) for x in s)})"
    choose = lambda latin, cyrillic, greek: f"CASE WHEN canon RLIKE '\\\\p{{IsCyrillic}}' THEN {cyrillic} WHEN canon RLIKE '\\\\p{{IsGreek}}' THEN {greek} ELSE {latin} END"
    ending = f"CASE left(canon, 2) WHEN 'f ' THEN {choose(repr('na'), repr('на'), repr('να'))} WHEN 'm ' THEN {choose(repr('nor'), repr('нов'), repr('νος'))} ELSE {choose(repr('ni'), repr('ни'), repr('νι'))} END"
    spelt = lambda syllables, n: f"array_join(transform(split(substr({hex_}, 5, {n} + 2 * least(attempt, 28)), ''), h -> element_at({syllables}, 1 + CAST(conv(h, 16, 10) AS INT))), '')"
    word = f"concat({spelt(choose(table(LATIN), table(CYRILLIC), table(GREEK)), 4)}, {ending})"
    both = f"IF(canon RLIKE '\\\\p{{IsHan}}', {spelt(table(HAN), 'length(canon) - 2')}, {word})"
    return f"""CASE kind
      WHEN 'email' THEN concat(left({letters}, 7), regexp_extract(canon, '[._+-](?=[0-9]+@)', 0), substr({digits}, 1, length(regexp_extract(canon, '([0-9]*)@', 1))), '@',
        substr({letters}, 20, 6), '.example.', element_at(array('com', 'net', 'org'), 1 + length(canon) % 3))
      WHEN 'ip' THEN concat_ws('.', {octet(0)}, {octet(1)}, {octet(2)}, {octet(3)})
      WHEN 'iban' THEN concat(left(canon, 2), substr({digits}, 1, 2), upper(translate(substr(canon, 5), '0123456789', substr({digits}, 3, 10))), '')
      WHEN 'name' THEN concat(left(canon, 2), {both})
      WHEN 'card' THEN IF({_luhn('canon')} % 10 = 0, concat({body}, {check}), {keep_one})
      ELSE {keep_one} END"""


def shown(match: Column, kind: Column, form: Column) -> Column:
    """A surrogate in the format of the original: its punctuation, spacing and capitals."""
    digits = F.expr("aggregate(split(m.match, ''), struct('' AS out, 1 AS k), (a, c) -> IF(c RLIKE '[A-Za-z0-9]', struct(concat(a.out, substr(replace(m.form, '+', ''), a.k, 1)) AS out, a.k + 1 AS k), struct(concat(a.out, c) AS out, a.k AS k)), a -> a.out)")
    name = F.substr(form, F.lit(3))
    proper = F.when((match == F.upper(match)) & (match != F.lower(match)), F.upper(name)).otherwise(F.initcap(name))
    return F.when(kind == "email", form).when(kind == "ip", form).when(kind == "name", proper).otherwise(digits)


def _space() -> list[Column]:
    """Type, length and first digit (or country code) of a number; all that a surrogate of it keeps."""
    return [F.col("kind"), F.length("canon").alias("size"), F.expr(_HEAD).alias("head")]


def dealt(every: DataFrame, key: str = KEY) -> DataFrame | None:
    """``kind, canon, form`` of the numbers in spaces too full for tries; None if there is no such space.

    A space is at most 1 / MOST_LOAD times its real numbers, so its table grows as theirs.
    """
    spark = every.sparkSession
    numbers = every.where(F.col("kind").isin("ssn", "phone") | (F.col("kind") == "card") & F.expr(f"{_luhn('canon')} % 10 <> 0"))
    # At most ten rows and one a country code per type and length.
    full = numbers.groupBy(*_space()).count().where(F.col("count") > F.lit(MOST_LOAD) * F.pow(F.lit(10.0), F.col("size") - F.length("head"))).collect()
    if not full:
        return None
    spaces = literal_rows(spark, [(r.kind, r.size, r.head, 10 ** (r.size - len(r.head)), 2 * r["count"] > 10 ** (r.size - len(r.head))) for r in full], "kind string, size int, head string, forms bigint, over boolean")
    blocks = spaces.withColumn("block", F.expr("explode(sequence(0L, (forms - 1) DIV 10000))")).repartition("kind", "size", "head", "block")
    rows = blocks.withColumn("at", F.expr("explode(sequence(block * 10000, least(forms, (block + 1) * 10000) - 1))"))
    rows = rows.select("kind", "size", "head", "over", F.concat("head", F.expr("IF(size > length(head), lpad(CAST(at AS STRING), size - length(head), '0'), '')")).alias("canon"))
    rows = rows.join(numbers.select("kind", "canon", F.lit(True).alias("real")), ["kind", "canon"], "left")
    order = [F.sha2(F.concat(F.lit(key), "kind", F.lit(":"), "canon"), 256), F.col("canon")]
    own, group = Window.partitionBy("kind", "size", "head"), ["kind", "size", "head"]
    crowded = rows.where("over")
    following = F.coalesce(F.lead("canon").over(own.orderBy(*order)), F.first("canon").over(own.orderBy(*order)))
    shifted = crowded.withColumn("form", following).where("real").select("kind", "canon", "form")
    ranked = materialize(rows.where("NOT over").withColumn("rank", F.row_number().over(Window.partitionBy(*group, "real").orderBy(*order))), "ranks")
    free = ranked.where("real IS NULL").select(*group, "rank", F.col("canon").alias("form"))
    return shifted.union(ranked.where("real").join(free, [*group, "rank"]).select("kind", "canon", "form"))


def mapping(found: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, canon, form`` for every distinct entity of ``found(kind, canon)``, without collisions."""
    every = materialize(found.distinct(), "entities")
    given = dealt(every, key)
    if given is None:
        return tried(every, every, key)
    given = materialize(given, "dealt")
    return given.unionByName(tried(every.join(given, ["kind", "canon"], "left_anti"), every, key))


def tried(some: DataFrame, every: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, canon, form`` of ``some`` entities by tries until none of them collides with another or with one of ``every``."""
    plain = lambda c: F.when(F.col("kind") == "name", F.substr(c, F.lit(3))).otherwise(F.col(c))
    formed = materialize(some.withColumn("attempt", F.lit(0)).withColumn("form", F.expr(surrogate(key))), "forms")
    for _ in range(MOST_ATTEMPTS):
        # Names of different gender are compared without it.
        written = formed.withColumn("form", plain("form"))
        twice = written.groupBy("kind", "form").agg(F.min("canon").alias("first"), F.count("*").alias("n")).where("n > 1").select("kind", "form", "first")
        clash = written.join(twice, ["kind", "form"]).where("canon <> first").select("kind", "canon")
        real = written.join(every.select("kind", plain("canon").alias("form")), ["kind", "form"], "left_semi").select("kind", "canon")
        again = materialize(clash.union(real).distinct().withColumn("again", F.lit(True)), "collisions")
        if not again.take(1):
            return formed.select("kind", "canon", "form")
        formed = materialize(formed.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("again"), 1).otherwise(0)).select("kind", "canon", "attempt").withColumn("form", F.expr(surrogate(key))), "forms")
    raise ValueError("surrogates still collide; the space of a type is too small for its entities")


def replaced(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with entities replaced, and ``n_entities``, the pieces replaced (in place of a column of that name)."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    body = F.col(text)
    has = body.rlike(NUMBER_HINT) & body.rlike(NUMBER) | body.rlike(NAME_HINT) & body.rlike(NAME)
    own = packed(docs, text).withColumn("_has", F.coalesce(has, F.lit(False)))
    plain = own.where(~F.col("_has")).drop("_has").withColumn("n_entities", F.lit(0))
    busy = own.where("_has").drop("_has").withColumn("_doc", F.xxhash64(text))
    none = F.array().cast("array<string>")
    all_of = lambda hint, pattern: F.when(body.rlike(hint), F.regexp_extract_all(body, F.lit(pattern), F.lit(0))).otherwise(none)
    seen = busy.select("_doc", all_of(NUMBER_HINT, NUMBER).alias("numbers"), all_of(NAME_HINT, NAME).alias("names"))
    of_names = F.flatten(F.transform("names", lambda n: F.transform(name_parts(n), lambda p: F.struct(p.alias("match"), F.lit("name").alias("kind"), gender(n).alias("gender")))))
    of_numbers = F.transform("numbers", lambda n: F.struct(n.alias("match"), kind_of(n).alias("kind"), F.lit(None).cast("string").alias("gender")))
    found = seen.select("_doc", F.explode(F.concat(of_numbers, of_names)).alias("_e")).select("_doc", F.col("_e.match").alias("_match"), "_e.kind", "_e.gender").distinct()
    found = materialize(found.withColumn("same", canonical(F.col("kind"), F.col("_match"))), "found")
    men, women = (F.coalesce(F.bool_or(F.col("gender") == g), F.lit(False)) for g in "mf")
    prefix = F.when(F.col("kind") != "name", "").when(F.col("men") & ~F.col("women"), "m ").when(F.col("women") & ~F.col("men"), "f ").otherwise("n ")
    entities = found.groupBy("kind", "same").agg(men.alias("men"), women.alias("women")).select("kind", F.concat(prefix, "same").alias("canon"))
    forms = mapping(entities, key).select("kind", F.when(F.col("kind") == "name", F.substr("canon", F.lit(3))).otherwise(F.col("canon")).alias("same"), "form")
    m = F.struct(F.col("_match").alias("match"), F.col("form").alias("form"))
    written = found.select("_doc", "_match", "kind", "same").distinct().join(forms, ["kind", "same"])
    # A part of a name may stand elsewhere in other capitals; spellings of other lower case are other parts.
    capitals = F.when(F.col("kind") == "name", F.filter(F.array_distinct(F.array("_match", F.initcap("_match"), F.upper("_match"))), lambda x: F.lower(x) == F.col("same"))).otherwise(F.array("_match"))
    pairs = written.select("_doc", "kind", "form", F.explode(capitals).alias("_match")).distinct().withColumn("m", m)
    pairs = pairs.select("_doc", (F.col("kind") == "name").alias("_name"), "_match", shown(F.col("_match"), F.col("kind"), F.col("form")).alias("_new"))
    # All matches of one text, a bound that its length sets.
    per_text = pairs.groupBy("_doc").agg(F.map_from_entries(F.collect_list(F.struct("_match", "_new"))).alias("_map"), F.bool_or("_name").alias("_names"))
    pattern = F.when(F.col("_names"), F.lit(PIECE)).otherwise(F.lit(NUMBER))
    parts = busy.join(per_text, "_doc").withColumn("_found", F.regexp_extract_all(body, pattern, F.lit(0))).withColumn("_parts", F.split(body, pattern, -1))
    parts = parts.withColumn("_new", F.transform("_found", lambda x: F.try_element_at("_map", x)))
    new = F.expr("array_join(zip_with(_parts, array_append(zip_with(_new, _found, (n, x) -> coalesce(n, x)), ''), (p, f) -> concat(p, coalesce(f, ''))), '')")
    changed = parts.withColumn("n_entities", F.size(F.array_compact("_new"))).withColumn(text, new).drop("_doc", "_map", "_names", "_found", "_parts", "_new")
    return plain.unionByName(changed).select(*unpacked([c for c in docs.columns if c != "n_entities"], text), "n_entities")
