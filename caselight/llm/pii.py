"""PII surrogates: detected entities get keyed replacements of the same type, shape and script.

One pattern finds all entities. Each is brought to a canonical form, so that spellings of one
entity (a number with other separators, an address in capitals) share a surrogate. A name is
taken by its parts: a given name of some gender and a surname each have a surrogate, so a person
named by surname alone keeps the surname. The surrogate comes from a keyed digest: digits for
digits, letters of the same script for letters, valid check digits for valid ones, names that fit
the gender that a title or a given name shows. A collision check over the whole corpus gives
another attempt to every entity but the first of those that would share a surrogate, and to
those whose surrogate is itself an entity of the corpus; so different entities stay different.
After ATTEMPTS that keep the shape, the last one adds signs, more than 2^100 choices for each
entity. Only DataFrame functions are used.

Defined cases: null and empty texts stay as they are, without entities; repeated rows get equal
replacements; a null doc_id is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, keep_lineage_short

#: The session setting that holds the key of the digests; queries take EXAMPLE_KEY where it is not set.
KEY_SETTING, EXAMPLE_KEY = "spark.caselight.pii.key", "example key"
#: Attempts at a surrogate of the entity's own shape, and signs that the one after those adds.
ATTEMPTS, LAST_SIGNS = 12, 24
NO_ID = -(1 << 63)

#: Titles before names, by gender.
FEMALE = "Mrs|Ms|Miss|Mme|Madame|Frau|Señora|Sra|Doña|госпожа|Госпожа|г-жа"
MALE = "Mr|Monsieur|Herr|Señor|Sr|Don|господин|Господин|г-н"
NEUTRAL = "Dr|Prof|Professor"
#: Given names that show a gender, in Latin and Cyrillic script.
WOMEN = (
    "Alice|Anna|Anne|Barbara|Carmen|Catherine|Charlotte|Claire|Elena|Elizabeth|Emily|Emma|Eva|Heike|Helen|Isabel|Jane|Jennifer|Jessica|Julia|Karen|Laura|"
    "Linda|Lisa|Lucía|Margaret|Maria|María|Marie|Mary|Nancy|Olga|Patricia|Petra|Rachel|Sabine|Sandra|Sarah|Sofia|Sophie|Susan|Ursula|"
    "Анна|Елена|Екатерина|Ирина|Мария|Наталья|Ольга|Светлана|Татьяна|Юлия"
)
MEN = (
    "Alexander|Andreas|Antoine|Antonio|Carlos|Charles|Christopher|Daniel|David|Dmitry|Francisco|George|Hans|Ivan|Jack|James|Javier|Jean|John|José|Joseph|Juan|"
    "Jürgen|Klaus|Louis|Luis|Manuel|Mark|Matthew|Michael|Miguel|Paul|Peter|Pierre|Richard|Robert|Stefan|Steven|Thomas|William|Wolfgang|"
    "Александр|Алексей|Андрей|Владимир|Дмитрий|Иван|Михаил|Николай|Павел|Сергей"
)
#: What stands before a secret, in any case.
LABELS = "password|passwd|pwd|secret|token|api_key|apikey"
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9+])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-]?[0-9]{2}[ .-]?[0-9]{2}(?![0-9])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": rf"(?<=(?i:{LABELS}) ?[=:] ?\"?)[A-Za-z0-9+/_-]{{8,}}",
    "name": rf"(?<![\p{{L}}-])(?=\p{{L}})(?:{FEMALE}|{MALE}|{NEUTRAL})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
    rf"|(?<![\p{{L}}-])(?=\p{{Lu}})(?:{WOMEN}|{MEN})(?: \p{{Lu}}\.)? \p{{Lu}}[\p{{L}}'-]+",
}
ENTITY = "|".join(f"(?:{p})" for p in _PATTERNS.values())
#: The same for texts without an at sign, which have no addresses.
NO_ADDRESS = "|".join(f"(?:{p})" for kind, p in _PATTERNS.items() if kind != "email")
#: Every entity has a digit, an at sign, a title or a word for secrets; cheap to look for first.
HINT = rf"[0-9@]|(?i:{LABELS})|(?:{FEMALE}|{MALE}|{NEUTRAL})\.? \p{{Lu}}|(?=\p{{Lu}})(?:{WOMEN}|{MEN}) (?:\p{{Lu}}\. )?\p{{Lu}}"
_SYLLABLES = "ba be bo da de di do fa fe ga go ha hi ja jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi za"
_CYRILLIC = "ба бе бо да де ди до фа фе га го ха хи жа жо ка ке ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви за"


def entity_type(value: Column) -> Column:
    """The type of a whole entity, from its text."""
    out = F.when(value.contains("@"), "email")
    title = rf"^(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.?|(?:{WOMEN}|{MEN})(?: \p{{Lu}}\.)?) \p{{Lu}}"
    tests = {
        "name": title,
        "key": "^(?:AKIA|ASIA)[A-Z0-9]{16}$",
        "ip": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$",
        "card": "^[0-9]{4}(?:[ -]?[0-9]{4}){3}$",
        "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
        "phone": r"^[+(]?[0-9][0-9 ().-]*$",
        "iban": "^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,}",
    }
    for name, pattern in tests.items():
        out = out.when(value.rlike(pattern), name)
    return out.otherwise("secret")


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^((?:{FEMALE}|{MALE}|{NEUTRAL})\.? )", 1)


def canonical(kind: Column, value: Column) -> Column:
    """One form for all spellings of an entity; a name is led by its gender, f, m or n."""
    packed = F.lower(F.regexp_replace(value, r"[ ().+-]", ""))
    bare = F.substring(value, F.length(_title(value)) + 1, F.length(value))
    female = value.rlike(rf"^(?:{FEMALE})\.? ") | bare.rlike(f"^(?:{WOMEN}) ")
    male = value.rlike(rf"^(?:{MALE})\.? ") | bare.rlike(f"^(?:{MEN}) ")
    gender = F.when(female, "f").when(male, "m").otherwise("n")
    name = F.concat(gender, F.lit(" "), F.lower(bare))
    return (
        F.when(kind == "name", name)
        .when(kind == "phone", F.right(F.regexp_replace(F.regexp_replace(value, r"^\+[0-9]{1,3}[ .-]", ""), "[^0-9]", ""), F.lit(10)))
        .when(kind.isin("email", "ip"), F.lower(value))
        .when(kind == "secret", value)
        .otherwise(packed)
    )


def _digest(kind: Column, value: Column, attempt: Column) -> Column:
    """128 hex digits, by the key in the column _key."""
    text = F.concat_ws("\u0001", F.col("_key"), kind, value, attempt.cast("string"))
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(text, F.lit("+")), 256))


def _number(digest: Column, i: int, digits: int = 4) -> Column:
    """A number from the digest, for position i."""
    return F.conv(F.substring(digest, i * 3 % (128 - digits) + 1, digits), 16, 10).cast("long")


def _turned(digest: Column, by: int) -> Column:
    """The digest read from another digit on."""
    return F.concat(F.substring(digest, by + 1, 128), F.substring(digest, 1, by))


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (n % len(letters)).cast("int") + 1, F.lit(1))


def like(value: Column, digest: Column) -> Column:
    """Characters of the same kind, script and case in place of letters and digits; hex stays hex."""
    kinds = (
        ("[0-9]", "0123456789"),
        ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
        ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"),
        (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
        (r"\p{Ll}", "abcdefghijklmnopqrstuvwxyz"),
        (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    )

    def one(c: Column, n: Column) -> Column:
        found = F.when(c.rlike(kinds[0][0]), _pick(kinds[0][1], n))
        for pattern, letters in kinds[1:]:
            found = found.when(c.rlike(pattern), _pick(letters, n))
        return found.otherwise(c)

    signs = F.split(value, "")
    # three hex digits for each sign, again from the first on; outside the functions over signs, so the digest is worked out once
    numbers = F.transform(F.regexp_extract_all(digest, F.lit("([0-9a-f]{3})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("int"))
    many = F.slice(F.flatten(F.array_repeat(numbers, (F.size(signs) / 42 + 1).cast("int"))), 1, F.size(signs))
    over = lambda pick: F.zip_with(signs, many, pick)
    hexed = lambda letters: over(lambda _, n: _pick(letters, n))
    is_hex, is_upper_hex = (value.rlike(f"^(?=.*[0-9])(?=.*[{x}])[0-9{x}]{{12,}}$") for x in ("a-f", "A-F"))
    made = F.when(is_hex, hexed("0123456789abcdef")).when(is_upper_hex, hexed("0123456789ABCDEF")).otherwise(over(one))
    return F.array_join(made, "")


def _piece(text: Column, digest: Column) -> Column:
    """What `like` is to replace, with the digest that it does so by."""
    return F.struct(text.alias("text"), digest.alias("digest"))


def _luhn_sum(digits: Column) -> Column:
    """The check sum of a number whose last digit is the check digit."""
    reversed_ = F.split(F.reverse(digits), "")

    def one(c: Column, i: Column) -> Column:
        d = F.coalesce(c.try_cast("int"), F.lit(0))
        doubled = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(reversed_, one), F.lit(0), lambda a, b: a + b)


def _card_parts(value: Column, digest: Column) -> list[Column]:
    """The network's first digit stays; the last digit is apart, as it may be a check digit."""
    return [_piece(F.substring(value, F.lit(2), F.length(value) - 2), digest), _piece(F.right(value, F.lit(1)), _turned(digest, 60))]


def _card(value: Column, made: Column) -> Column:
    """A valid number stays valid; made are the pieces in their new signs."""
    body = F.concat(F.substring(value, 1, 1), F.get(made, 0))
    check = ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    return F.concat(body, F.when(_luhn_sum(value) % 10 == 0, check).otherwise(F.get(made, 1)))


def _mod97(packed: Column) -> Column:
    """The remainder of a number whose letters stand for 10 to 35."""
    value = lambda c: F.ascii(c) - F.when(c.rlike("[0-9]"), 48).otherwise(87)
    return F.aggregate(F.split(packed, ""), F.lit(0), lambda total, c: (total * F.when(value(c) < 10, 10).otherwise(100) + value(c)) % 97)


def _iban_parts(value: Column, digest: Column) -> list[Column]:
    return [_piece(F.substring(value, F.lit(5), F.length(value)), digest), _piece(F.substring(value, 3, 2), _turned(digest, 60))]


def _iban(value: Column, made: Column) -> Column:
    """The country stays; the check digits of a valid number are those of its surrogate."""
    country, body = F.substring(value, 1, 2), F.get(made, 0)
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))) == 1
    return F.concat(country, F.when(valid, check).otherwise(F.get(made, 1)), body)


def _name_part(digest: Column, syllables: int, cyrillic: Column, ending: Column) -> Column:
    listed = F.split(F.when(cyrillic, _CYRILLIC).otherwise(_SYLLABLES), " ")
    parts = [F.get(listed, (_number(digest, i, 6) % F.size(listed)).cast("int")) for i in range(syllables)]
    return F.initcap(F.concat(*parts, ending))


def name_parts(kind: Column, value: Column) -> Column:
    """What gets a surrogate of its own (array of kind, canonical): a name's parts, or the entity itself."""
    words = F.split(F.substring(value, F.lit(3), F.length(value)), " ")
    part = lambda name, text: F.struct(F.lit(name).alias("kind"), text.alias("canonical"))
    surname = part("surname", F.element_at(words, -1))
    given = part("given", F.concat(F.substring(value, 1, 2), F.get(words, 0)))
    name = F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname))
    return F.when(kind == "name", name).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("canonical"))))


def with_surrogates(entities_: DataFrame, attempt: int, key: str) -> DataFrame:
    """Adds surrogate, the replacement of a canonical entity or a name's part at some attempt, canonical but for names' case.

    The digest is a column first, so it is worked out once, and so are the pieces that `like`
    replaces: an entity of any kind is an array of them, so the plan holds `like` once, not once
    for each kind. The key is in a row of its own, so no plan shows it. Names and the hosts of
    addresses grow with the attempt; after ATTEMPTS, everything does.
    """
    last = attempt >= ATTEMPTS
    longer = LAST_SIGNS if last else attempt
    own_key = entities_.sparkSession.createDataFrame([(key,)], "_key string")
    kind, value = F.col("kind"), F.col("canonical")
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    gender = F.substring(value, 1, 1)
    end = F.when(gender == "f", F.when(cyrillic, "на").otherwise("na")).when(gender == "m", F.when(cyrillic, "р").otherwise("r")).otherwise(F.when(cyrillic, "н").otherwise("n"))
    d, spare = F.col("_d"), F.lit("0" * LAST_SIGNS if last else "")
    at = F.instr(value, "@")
    local, host = F.substring(value, F.lit(1), at - 1), F.substring(value, at + 1, F.length(value))
    label = F.concat(F.regexp_extract(host, r"^([^.]*)", 1), F.lit("x" * longer))
    more = _piece(spare, _turned(d, 30))
    pieces = (
        F.when(kind == "email", F.array(_piece(local, d), _piece(label, _turned(d, 50))))
        .when(kind == "card", F.array(*_card_parts(value, d), more))
        .when(kind == "key", F.array(_piece(F.concat(F.substring(value, F.lit(5), F.length(value)), spare), d)))
        .when(kind == "iban", F.array(*_iban_parts(value, d), more))
        .when(~kind.isin("ip", "given", "surname"), F.array(_piece(F.concat(value, spare), d)))
    )
    made = F.col("_made")
    zone = F.get(F.array(*map(F.lit, ("com", "net", "org"))), (_number(d, 40) % 3).cast("int"))
    email = F.concat(F.get(made, 0), F.lit("@"), F.regexp_replace(F.get(made, 1), "-", "x"), F.lit(".example."), zone)
    short_ip = F.concat_ws(".", *[(_number(d, i * 3) % 254 + 1).cast("string") for i in range(4)])
    long_ip = F.concat(F.lit("fd00:"), F.concat_ws(":", *[F.substring(d, i * 4 + 1, 4) for i in range(7)]))
    chosen = (
        F.when(kind == "email", email)
        .when(kind == "ip", long_ip if last else short_ip)
        .when(kind == "card", F.concat(_card(value, made), F.get(made, 2)))
        .when(kind == "key", F.concat(F.substring(value, 1, 4), F.get(made, 0)))
        .when(kind == "iban", F.concat(_iban(value, made), F.get(made, 2)))
        .when(kind == "given", _name_part(d, 2 + longer, cyrillic, end))
        .when(kind == "surname", _name_part(d, 3 + longer, cyrillic, F.when(cyrillic, "ев").otherwise("son")))
        .otherwise(F.get(made, 0))
    )
    # one row, the key
    keyed = entities_.crossJoin(F.broadcast(own_key)).withColumn("_d", _digest(kind, value, F.lit(attempt)))
    keyed = keyed.withColumn("_made", F.transform(pieces, lambda p: like(p["text"], p["digest"])))
    return keyed.withColumn("surrogate", chosen).drop("_key", "_d", "_made")


#: The letters that initials are turned among; the turn is the key's.
_INITIALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC_INITIALS = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"


def initials(key: str) -> tuple[str, str]:
    """Letters, and what stands for each: other letters, different ones for different letters."""
    by = int.from_bytes(hashlib.sha256(f"{key}\u0001initials".encode()).digest()[:8], "big")
    turned = [x[n:] + x[:n] for x in (_INITIALS, _CYRILLIC_INITIALS) if (n := 1 + by % (len(x) - 1))]
    return _INITIALS + _CYRILLIC_INITIALS, "".join(turned)


def whole_name(value: Column, parts: Column, turned: tuple[str, str]) -> Column:
    """A name from the surrogates of its parts; a Cyrillic surname agrees with the gender, an initial is turned."""
    surname = F.element_at(parts, -1)
    woman = F.substring(value, 1, 1) == "f"
    fitted = F.when(woman & surname.rlike(r"\p{IsCyrillic}"), F.concat(surname, F.lit("а"))).otherwise(surname)
    initial = F.translate(F.upper(F.regexp_extract(value, r" (\p{L}\.) ", 1)), *turned)
    given = F.when(F.size(parts) > 1, F.get(parts, 0))
    return F.concat_ws(" ", given, F.nullif(initial, F.lit("")), fitted)


def shaped(kind: Column, value: Column, found: Column) -> Column:
    """The surrogate in the separators, case and country code of the entity as it was written."""
    packed = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    kept = F.greatest(F.length(packed) - F.length(found), F.lit(0))
    signs = F.split(F.concat(F.substring(packed, F.lit(1), kept), found), "")
    gaps = F.split(value, "[A-Za-z0-9]", -1)
    put = F.zip_with(gaps, signs, lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit(""))))
    filled = F.array_join(put, "")
    upper = F.upper(filled)
    shape = F.when(kind.isin("key", "iban"), upper).otherwise(filled)
    capitals = (F.upper(value) == value) & value.rlike("[A-Z]")
    return (
        F.when(kind == "name", F.concat(_title(value), found))
        .when(kind == "email", F.when(capitals, F.upper(found)).otherwise(found))
        .when(kind.isin("ip", "secret"), found)
        .otherwise(shape)
    )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _by_address(text: Column, use) -> Column:
    """use(pattern) with the pattern that the text needs: addresses cost most to look for."""
    return F.when(text.contains("@"), use(ENTITY)).otherwise(use(NO_ADDRESS))


def entities(docs: DataFrame) -> DataFrame:
    """doc, mark (a hash of the text), pos (from 0), value, kind and canonical of every entity."""
    keyed = _keyed(docs).where(F.col("text").rlike(HINT))
    values = _by_address(F.col("text"), lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    found = keyed.select("doc", "mark", F.posexplode(values).alias("pos", "value"))
    typed = found.withColumn("kind", entity_type(F.col("value")))
    return typed.withColumn("canonical", canonical(F.col("kind"), F.col("value")))


def assign(distinct_parts: DataFrame, key: str) -> DataFrame:
    """kind, canonical and surrogate: no two of a kind share one, none is one of the corpus itself."""
    names = keep_lineage_short(distinct_parts.select("kind", "canonical").distinct())
    # a woman's surname has one letter more than the form that is compared
    plain = F.when(F.col("kind") == "surname", F.regexp_replace("canonical", "а$", "")).otherwise(F.col("canonical"))
    taken = keep_lineage_short(names.select("kind", F.explode(F.array_distinct(F.array("canonical", plain))).alias("name")).distinct())
    settled, open_ = None, names
    for attempt in range(ATTEMPTS + 1):
        tried = with_surrogates(open_, attempt, key)
        named = tried.withColumn("name", F.when(F.col("kind") == "given", F.concat(F.substring("canonical", 1, 2), F.lower("surrogate"))).otherwise(F.lower("surrogate")))
        free = named.join(taken, ["kind", "name"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "name"), ["kind", "name"], "left_anti")
        # the first of those that share a name takes it, in one grouping: `free` is not worked out twice
        won = keep_lineage_short(free.groupBy("kind", "name").agg(F.min(F.struct("canonical", "surrogate")).alias("first")).select("kind", "first.*", "name"))
        settled = won if settled is None else settled.union(won)
        open_ = keep_lineage_short(open_.join(won, ["kind", "canonical"], "left_anti"))
        if open_.isEmpty():
            return settled.select("kind", "canonical", "surrogate")
    raise ValueError("two entities share a surrogate of more than 2^100 choices: the digests are broken")


def replacements(docs: DataFrame, key: str) -> DataFrame:
    """doc, mark and put: the replacements of a document's entities, in order of place."""
    found = keep_lineage_short(entities(docs).withColumn("parts", name_parts(F.col("kind"), F.col("canonical"))))
    parts = found.select("doc", "mark", "pos", "value", F.col("kind").alias("whole_kind"), F.col("canonical").alias("whole"), F.posexplode("parts").alias("nth", "part"))
    parts = parts.select("*", "part.kind", "part.canonical").drop("part")
    chosen = parts.join(assign(parts, key), ["kind", "canonical"])
    joined = chosen.groupBy("doc", "mark", "pos", "value", "whole_kind", "whole").agg(F.transform(F.sort_array(F.collect_set(F.struct("nth", "surrogate"))), lambda x: x["surrogate"]).alias("parts"))
    surrogate = F.when(F.col("whole_kind") == "name", whole_name(F.col("whole"), F.col("parts"), initials(key))).otherwise(F.get("parts", 0))
    placed = joined.withColumn("surrogate", surrogate).select("doc", "mark", "pos", shaped(F.col("whole_kind"), F.col("value"), F.col("surrogate")).alias("put"))
    return placed.groupBy("doc", "mark").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "put"))), lambda x: x["put"]).alias("put"))


def _rewritten(text: Column, put: Column) -> Column:
    gaps = _by_address(text, lambda pattern: F.split(text, pattern, -1))
    joined = F.zip_with(gaps, put, lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
    return F.array_join(joined, "")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, and n_entities, for each row."""
    put = replacements(docs, key)
    keyed = _keyed(docs)
    hinted = F.col("text").rlike(HINT)
    doc_id = F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id")
    with_any = keyed.where(hinted).join(put, ["doc", "mark"], "left")
    text = F.when(F.col("put").isNull(), F.col("text")).otherwise(_rewritten(F.col("text"), F.col("put")))
    some = with_any.select(doc_id, text.alias("text"), F.coalesce(F.size("put"), F.lit(0)).cast("long").alias("n_entities"))
    none = keyed.where(~hinted).select(doc_id, "text", F.lit(0).cast("long").alias("n_entities"))
    return some.union(none)


def without_pii(docs: DataFrame, key: str) -> DataFrame:
    """The documents with all their columns; only text changes."""
    doc, mark, own = (free_name(docs, n) for n in ("_doc", "_mark", "_put"))
    put = replacements(docs, key).select(F.col("doc").alias(doc), F.col("mark").alias(mark), F.col("put").alias(own))
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    some = docs.where(hinted)
    on = (F.coalesce(some["doc_id"].cast("long"), F.lit(NO_ID)) == F.col(doc)) & (F.xxhash64(some["text"]) == F.col(mark))
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(_rewritten(F.col("text"), F.col(own)))
    changed = some.join(put, on, "left").withColumn("text", text).drop(doc, mark, own)
    return changed.unionByName(docs.where(~hinted))
