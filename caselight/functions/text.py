"""Text functions as column expressions. Letters are matched Unicode-aware, (?U) or (?iu)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits, signs and Latin letters that stand for Cyrillic ones.
LOOKALIKE_FROM, LOOKALIKE_TO = "0134@$acekopxy", "оиеаасасекорху"

#: Moderation rules in order; a confirmed one wins over an ambiguous one.
PREFIXES = "на|по|за|от|вы|о|до|пере"
CONFIRMED_RULES = (
    ("PROFANITY_001", r"(?<![\p{L}\p{N}_])бля[а-яё]*(?![\p{L}\p{N}_])"),
    ("PROFANITY_002", rf"(?<![\p{{L}}\p{{N}}_])(?:{PREFIXES})?ху[йеяю][а-яё]*(?![\p{{L}}\p{{N}}_])"),
    ("PROFANITY_003", r"(?<![\p{L}\p{N}_])пизд[а-яё]*(?![\p{L}\p{N}_])"),
    ("PROFANITY_004", rf"(?<![\p{{L}}\p{{N}}_])(?:(?:{PREFIXES})ъ?)?[её]б(?!итда)[а-яё]*(?![\p{{L}}\p{{N}}_])"),
    ("PROFANITY_005", r"(?<![\p{L}\p{N}_])сук[аи][а-яё]*(?![\p{L}\p{N}_])"),
)
AMBIGUOUS_RULES = (
    ("PROFANITY_A01", r"(?<![\p{L}\p{N}_])дур(?!ман)[а-яё]*(?![\p{L}\p{N}_])"),
    ("PROFANITY_A02", r"(?<![\p{L}\p{N}_])идиот[а-яё]*(?![\p{L}\p{N}_])"),
    ("PROFANITY_A03", r"(?<![\p{L}\p{N}_])туп(?!ик)[а-яё]*(?![\p{L}\p{N}_])"),
)
#: Phrases that ask for a person, and that decline to answer.
HUMAN_PHRASES = (
    "живой человек", "живого человека", "с человеком", "техподдержк", "позови специалиста", "позовите специалиста", "позвать специалиста",
    "хочу специалиста", "хочу оператора", "соедини с", "соедините", "переключи на", "переключите на",
)
OPERATOR = r"(?iu)(?<![\p{L}\p{N}_])оператор[а-яё]*(?![\p{L}\p{N}_])(?!\s+(?:эдо|электронного\s+документооборота))"
DECLINE_PHRASES = ("не знаю", "незнаю", "не в курсе", "нет информации", "затрудняюсь ответить", "неизвестно")
GREETING = r"(?iu)^\s*(?:привет|здравствуйте|здрасте|добрый\s+(?:день|вечер)|доброе\s+утро|хай|hello|hi)[!,.\s]*$"
THANKS = r"(?iu)^\s*(?:спасибо|благодарю|спс)[!,.\s]*$"

#: Direct identifiers, in the order in which they are replaced.
REDACTIONS = (
    (r"(?i)(?<![\p{L}\p{N}_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\p{L}\p{N}_])", "[EMAIL]"),
    (r"(?<!\d)(?:\+7|8)[\s()\-]*\d{3}[\s()\-]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}(?!\d)", "[PHONE]"),
    (r"(?i)(?<![\p{L}\p{N}_])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}(?![\p{L}\p{N}_])", "[IDENTIFIER]"),
    (r"(?iu)(?<![\p{L}\p{N}_])(?:ИНН|КПП|ОГРН|СНИЛС|логин|идентификатор(?:\s+пользователя)?|user\s*id)\s*[:№#-]?\s*[A-ZА-ЯЁ0-9._-]{4,}", "[IDENTIFIER]"),
    (r"(?<!\d)\d{8,}(?!\d)", "[IDENTIFIER]"),
    (r"(?iu)(?<![\p{L}\p{N}_])(?:ФИО|контактное\s+лицо|заявитель|пользователь)\s*[:№#-]?\s*[А-ЯЁ][а-яё-]+(?:\s+[А-ЯЁ][а-яё-]+){1,2}", "[PERSON]"),
)

#: Addresses and long numbers alone, wherever they stand. An address begins where its signs begin or the one before ends.
_SIGNS, _LETTERS = r"A-Za-z\u017F\u212A0-9._%+-", r"A-Za-z\u017F\u212A"
PLAIN_REDACTIONS = ((rf"(?:\G|(?<![{_SIGNS}]))[{_SIGNS}]+@[{_LETTERS}0-9.-]+\.[{_LETTERS}]{{2,}}", "[EMAIL]"), ("[0-9]{8,}", "[IDENTIFIER]"))
#: White space in all scripts, and that of ASCII.
SPACES, ASCII_SPACES = r"(?U)\s+", r"[ \t\n\r\x0b\x0c]+"

#: Signs of lines in documents. A word's ends are where letters and digits end.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
STEP = r"^\s*(?:\d+[.)]|[-–—•])\s+\S"
CONDITION = rf"(?iu)^\s*(?:если|при условии|при отсутствии|в случае|when|if){_AFTER}"
WARNING = rf"(?iu){_BEFORE}(?:внимание|важно|предупреждение|запрещено|warning|important){_AFTER}"
STATUS = rf"(?iu){_BEFORE}(?:статус|status|состояние|закрыт|отклонен|принят|active|closed){_AFTER}"
CODE = rf"```|{_BEFORE}(?:SELECT|INSERT|curl|python){_AFTER}"
DEFINITION = r"\s(?:—|-|:)\s"


def fold_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_query(text: Column) -> Column:
    """Search form of a text: no hard spaces, ё as е, single spaces, lower case; null stays null."""
    return F.lower(fold_spaces(F.translate(text, "\u00a0ёЁ", " еЕ")))


def normalize_question(text: Column) -> Column:
    """Key of a repeated question: lower case, single spaces, no closing marks."""
    return F.rtrim(fold_spaces(F.lower(text)), F.lit("?!. "))


def moderation_form(text: Column) -> Column:
    """Look-alikes resolved, punctuation dropped, stretched letters and spaces collapsed."""
    mapped = F.translate(F.lower(text), LOOKALIKE_FROM, LOOKALIKE_TO)
    bare = F.regexp_replace(mapped, r"[^\p{L}\p{N}\s\u00a0]", "")
    single = F.regexp_replace(bare, r"([\p{L}\p{N}])\1+", "$1")
    return F.ltrim(F.regexp_replace(single, r"[\s\u00a0]+", " "))


def moderation_rule(form: Column) -> Column:
    """Id of the first confirmed rule that matches, else of the first ambiguous one, else null."""
    hits = [F.when(form.rlike(f"(?iu){pattern}"), F.lit(name)) for name, pattern in (*CONFIRMED_RULES, *AMBIGUOUS_RULES)]
    return F.coalesce(*hits)


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.lower(text).contains(phrase)
    return found


def asks_for_human(text: Column) -> Column:
    return contains_any(text, HUMAN_PHRASES) | text.rlike(OPERATOR)


def declines(text: Column) -> Column:
    return contains_any(text, DECLINE_PHRASES)


#: What every identifier has: a digit, an at sign, or a label of a name.
REDACTION_HINT = r"(?iu)[0-9@]|фио|контактное|заявитель|пользовател|логин"


def _plain(text: Column, spaces: str) -> Column:
    filled = F.coalesce(text, F.lit(""))
    return F.translate(filled, "\u00a0", " ") if spaces == SPACES else filled


def redact(text: Column, rules: tuple[tuple[str, str], ...] = REDACTIONS, spaces: str = SPACES) -> Column:
    """The text without direct identifiers, single-spaced; a null text is empty."""
    plain = _plain(text, spaces)
    out = plain
    for pattern, mark in rules:
        out = F.regexp_replace(out, pattern, mark)
    return F.trim(F.regexp_replace(F.when(plain.rlike(REDACTION_HINT), out).otherwise(plain), spaces, " "))


def redaction_count(text: Column, rules: tuple[tuple[str, str], ...] = REDACTIONS, spaces: str = SPACES) -> Column:
    """Replacements that redact makes, each counted on what the ones before it left."""
    plain = _plain(text, spaces)
    out, total = plain, F.lit(0)
    for pattern, mark in rules:
        total = total + F.regexp_count(out, F.lit(pattern))
        out = F.regexp_replace(out, pattern, mark)
    return F.when(plain.rlike(REDACTION_HINT), total).otherwise(F.lit(0)).cast("long")


def case_title(text: Column) -> Column:
    """The first six words, at most 36 characters, cut at a space after the twelfth; ... if cut."""
    folded = fold_spaces(text)
    words = F.split(folded, " ")
    head = F.array_join(F.slice(words, 1, 6), " ")
    space = F.length(F.substring(head, 1, 36)) - F.coalesce(F.nullif(F.locate(" ", F.reverse(F.substring(head, 1, 36))), F.lit(0)), F.lit(99))
    short = F.when(space >= 12, F.substring(head, F.lit(1), space)).otherwise(F.substring(head, 1, 36))
    cut = F.when(F.length(head) > 36, short).otherwise(head)
    return F.when(F.length(cut) < F.length(folded), F.concat(cut, F.lit("…"))).otherwise(cut)


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4).cast("int"))


def line_kind(line: Column) -> Column:
    return (
        F.when(line.rlike(CONDITION), "condition")
        .when(line.rlike(WARNING), "warning")
        .when(line.rlike(STATUS) & line.rlike("[:—-]"), "status_rule")
        .when(line.rlike(STEP), "procedure_step")
        .when(line.rlike(CODE), "code_example")
        .when(line.rlike(DEFINITION), "definition")
        .otherwise("paragraph")
    )


def tokens(text: Column, least: int = 3, letters: str = r"[A-Za-zА-Яа-яЁё0-9]+") -> Column:
    """Lower-case runs of letters and digits of some length, digits of any."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({letters})"), F.lit(1))
    return F.filter(found, lambda t: (F.length(t) >= least) | t.rlike("^[0-9]+$"))


def stems(words: Column, letters: int = 5) -> Column:
    """Prefixes stand for the long words that are not plain ASCII."""
    return F.transform(words, lambda t: F.when((F.length(t) >= 6) & t.rlike(r"[^\x00-\x7F]"), F.substring(t, 1, letters)).otherwise(t))


def wire_name(name: Column) -> Column:
    """PascalCase as SCREAMING_SNAKE."""
    return F.upper(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def duration_minutes(text: Column) -> Column:
    """The first duration of a text in minutes; more than an hour said in words is 61; else null."""
    pattern = r"(?iu)(\d+(?:[.,]\d+)?)\s*(сек|мин|ч|д|мес)[\p{L}]*"
    number = F.regexp_replace(F.regexp_extract(text, pattern, 1), ",", ".").try_cast("double")
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    minutes = F.when(unit == "сек", number / 60).when(unit == "мин", number).when(unit == "ч", number * 60).when(unit == "д", number * 1440).when(unit == "мес", number * 43200)
    in_words = text.rlike(r"(?iu)(?:больше|более|прошл[\p{L}]*)\s+(?:одного\s+)?час")
    return F.when(minutes.isNotNull(), minutes).when(in_words, F.lit(61.0))


def without_thoughts(text: Column) -> Column:
    """A model's answer without its thoughts; null where the marks do not pair."""
    bare = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.when(~bare.rlike(r"(?i)</?think>"), F.trim(bare))


def source_name(path: Column) -> Column:
    """A path with plain separators and without empty and dot parts."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda p: ~p.isin("", ".")), "/")


#: Short names of documents and technical words that count as exact codes.
ABBREVIATIONS = ("упд", "укд", "мчд", "yml", "сте", "эдо", "эп", "рдик", "rdik")
TECHNICAL = ("pdf", "xml", "xlsx", "xls", "csp", "diadoc", "калуга", "астрал")
QUERY_TOKEN = r"(?<![\p{L}\p{N}_])([A-Za-zА-Яа-яЁё]+[A-Za-zА-Яа-яЁё0-9]*(?:[-_/][A-Za-zА-Яа-яЁё0-9]+)+|[A-Za-zА-Яа-яЁё]{2,8}|\d+)(?![\p{L}\p{N}_])"


def query_entities(text: Column) -> Column:
    """Typed tokens of a query (array of kind, value), in order, each once."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUERY_TOKEN), F.lit(1))

    def kind(t: Column) -> Column:
        name = normalize_query(t)
        return (
            F.when(name.isin(*ABBREVIATIONS), "document_abbreviation")
            .when(name.isin(*TECHNICAL), "technical_token")
            .when(t.rlike("[0-9]") & t.rlike("[-_/]"), "exact_code")
            .when(t.rlike("[0-9]") & (F.length(t) >= 2), "numeric_identifier")
        )

    typed = F.transform(found, lambda t: F.struct(kind(t).alias("kind"), t.alias("value")))
    return F.array_distinct(F.filter(typed, lambda x: x["kind"].isNotNull()))


def exact_codes(text: Column) -> Column:
    """The values of a query's typed tokens, each once."""
    return F.array_distinct(F.transform(query_entities(text), lambda x: x["value"]))


def language(text: Column) -> Column:
    return F.when(text.rlike("[А-Яа-яЁё]"), "ru").otherwise("unknown")


#: Names that history writes in Latin letters, and its prefix of a topic.
HISTORY_NAMES = (("упд", "upd"), ("укд", "ukd"), ("мчд", "mcd"))
TOPIC_PREFIX = r"(?iu)^\s*подтема\s+запроса\s*:\s*"


#: What stands between the words of a past question's search form.
HISTORY_GAPS = "[^a-zа-яё0-9]+"


def history_plain(text: Column) -> Column:
    """Past questions with no topic prefix and names in Latin letters; HISTORY_GAPS parts their words.

    A look for one sign comes first, as few texts have a prefix or a name.
    """
    out = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ё"), F.lit("е"))
    out = F.when(out.contains(":"), F.regexp_replace(out, TOPIC_PREFIX, "")).otherwise(out)
    named = out
    for name, latin in HISTORY_NAMES:
        named = F.replace(named, F.lit(name), F.lit(latin))
    return F.when(out.contains("д"), named).otherwise(out)


def history_words(plain: Column) -> Column:
    return F.array_join(F.regexp_extract_all(plain, F.lit("([a-zа-яё0-9]+)"), F.lit(1)), " ")


def history_form(text: Column) -> Column:
    """Search form of past questions: no topic prefix, names in Latin letters, words alone."""
    return history_words(history_plain(text))


#: Words that say nothing of a past question's matter.
HISTORY_STOP_WORDS = (
    "а без более бы был была были в во для до его ее их из или как мне мой моя на над не нет но о об от по под при с со так у уже что это я "
    "нужно можно пожалуйста подскажите помогите покажите здравствуйте"
).split()


def history_terms(text: Column) -> Column:
    """Stems of the words of a past question, repeats included."""
    words = F.filter(F.split(history_form(text), " "), lambda t: (F.length(t) >= 2) & ~t.isin(*HISTORY_STOP_WORDS))
    return stems(words, 6)


#: Words that deny each other.
OPPOSITES = (("можно", "нельзя"), ("обязательно", "не обязательно"), ("сохраняется", "не сохраняется"))


def contradict(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for yes, no in OPPOSITES:
        out = out | (a.contains(yes) & b.contains(no)) | (a.contains(no) & b.contains(yes))
    return out


#: What a query's words say of process, role, provider and document, the first that fits. Of several patterns all have to; W stands for letters and digits.
W = r"[\p{L}\p{N}_]*"
PROCESSES = (
    (rf"исправит{W}.*(?:упд|укд)|(?:упд|укд).*исправит", "UPD correction"),
    (("упд|укд|исполнен", rf"тип{W}\s+документ|добавление\s+исполнен"), "contract execution"),
    (r"упд|укд|исполнен", "UPD execution"),
    (r"мчд|доверен", "MCD management"),
    (r"yml|прайс", "YML import"),
    ((rf"ste|сте|оферт|импорт{W}\s+файл", "импорт|загрузк|статус"), "offer import"),
    (rf"ste|сте|оферт|импорт{W}\s+файл", "offer/STE"),
)
ROLES = (("администрат", "company administrator"), ("поставщик", "supplier"), ("заказчик", "customer"))
MANDATE_ROLES = (("администрат", "company administrator"), ("пользоват|поставщик", "supplier user"))
PROVIDERS = (("еис|эис", "EIS"), (rf"портал{W}\s+поставщик", "Supplier Portal"), (rf"портал{W}\s+заказчик", "Customer Portal"))
DOCUMENTS = (("upd|упд", "UPD"), ("ukd|укд", "UKD"), ("mcd|мчд", "MCD"), ("yml", "YML"), ("ste|сте", "STE"))
MENTIONS_STATUS, MENTIONS_CATEGORY, MENTIONS_MODEL = "статус|состояние", "категор|category|ppcategory", "модел"
ERROR_CODE = r"(?iu)((?:rdik|рдик)[_-][a-zа-яё0-9_-]+)"
ERROR_WORD = r"(?iu)(?<![A-Za-zА-Яа-яЁё0-9_-])((?:rdik|рдик)[a-zа-яё0-9_-]*)"
ATTEMPTED = r"(?iu)уже\s+(?:пробов|сделал|загрузил)|не\s+помогл"


def _first_said(text: Column, table: tuple) -> Column:
    out = []
    for patterns, value in table:
        fits = F.lit(True)
        for pattern in (patterns,) if isinstance(patterns, str) else patterns:
            fits = fits & text.rlike(f"(?iu){pattern}")
        out.append(F.when(fits, F.lit(value)))
    return F.coalesce(*out)


def context(text: Column, statuses: tuple[str, ...] = ()) -> dict[str, Column]:
    """What a query says of its case; null where it says nothing.

    statuses: those that cards declare, in their order; a status that is only mentioned is "present".
    """
    process = _first_said(text, PROCESSES)
    role = F.when(process == "MCD management", _first_said(text, MANDATE_ROLES)).otherwise(_first_said(text, ROLES))
    form = F.lower(F.translate(text, "ёЁ", "еЕ"))
    named = [F.when(form.contains(s.lower().replace("ё", "е")), F.lit(s)) for s in statuses]
    status = F.coalesce(*named, F.when(text.rlike(f"(?iu){MENTIONS_STATUS}"), "present"))
    code = F.coalesce(F.nullif(F.regexp_extract(text, ERROR_CODE, 1), F.lit("")), F.nullif(F.lower(F.regexp_extract(text, ERROR_WORD, 1)), F.lit("")))
    number = F.nullif(F.regexp_extract(text, r"(?<![\p{L}\p{N}_-])([0-9]+)", 1), F.lit(""))
    return {
        "role": role,
        "process": process,
        "provider": _first_said(text, PROVIDERS),
        "document_status": status,
        "error_code": code,
        "document_type": _first_said(text, DOCUMENTS),
        "attempted_action": F.when(text.rlike(ATTEMPTED), "already tried"),
        "duration_minutes": duration_minutes(text),
        "category_id": F.when(text.rlike(f"(?iu){MENTIONS_CATEGORY}"), number),
        "model": F.when(text.rlike(f"(?iu){MENTIONS_MODEL}"), "present"),
    }


def scope_reply(text: Column) -> Column:
    """Which server-side answer a plain greeting or thanks gets; null where the message goes on."""
    return F.when(text.rlike(GREETING), "GREETING").when(text.rlike(THANKS), "THANKS")
