"""Operator 8: surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern.  Each distinct entity of the corpus (by
kind and canonical form, so that mentions in other case or grouping are the
same one) gets a keyed surrogate of its own format: digits stay digits in
their grouping, letters keep their case and script, names their gender, and
check digits of cards and bank accounts are right.  The first surrogate is a
function of key and entity alone; those that collide with another entity's
surrogate or with any entity of the corpus take a further draw, round by
round.  A form with too few surrogates gets longer ones in the end, so the
rounds do end.  Texts are rewritten in their own rows; only the few entities
with a further draw are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashtable import bucket, buckets_for, lookup_table, once
from .names import free_name
from .scratch import written

#: Entries of further draws that are looked up in the row; more go through a join.
TABLE_ROWS = 50_000
#: Draws of a surrogate of the entity's own form; later ones are longer.
FORM_DRAWS = 3

#: Forms of address with the gender that they tell.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Госпожа"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"],
    "n": ["Dr", "Prof"],
}
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
#: What a person's name of two parts and a secret follow, in any case.
_NAME_CUE = r"(?i:my name is|name ?:|signed ?:?|regards,|sincerely,|contact ?:)"
_SECRET_CUE = r"(?i:token|secret|passwd|password|passphrase|pwd|api[_\-]?key|access[_\-]?key|private[_\-]?key)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: kind: pattern; of two that fit at a place the first is taken.
PATTERNS = {
    "secret": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})"
    # the short look behind rules nearly all places out before the long one
    rf"|(?<=[=:] ?[\"']?)(?<={_SECRET_CUE}[\"']? ?[=:] ?[\"']?)(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{{8,}}",
    "email": r"(?<![\p{L}0-9._%+\-])[\p{L}0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    # eight groups, or a first one of four digits or two and more before a gap
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:[0-9A-Fa-f]{{4}}:|(?:{_HEX}:){{2,6}}):(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![0-9A-Za-z:])",
    # issuers' ranges; the check digit is looked at afterwards
    "card": r"(?<![0-9A-Za-z.])(?:(?:4[0-9]{3}|5[1-5][0-9]{2}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)|35[0-9]{2}|6(?:011|5[0-9]{2}|4[4-9][0-9]|2[0-9]{2}))(?:[ \-]?[0-9]{4}){3}|3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|(?<![0-9A-Za-z.\-])\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9A-Za-z.\-])[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9.\-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?|(?<=[ :,])(?={_NAME} \p{{Lu}})(?<={_NAME_CUE} ?){_NAME} {_NAME}(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: As ``PATTERN``, with secrets as its one group: they can have the form of any other kind.
_SECRET_GROUP = "|".join(f"({p})" if k == "secret" else f"(?:{p})" for k, p in PATTERNS.items())
#: What every secret has or follows.
_SECRET_HINT = rf"AKIA|ASIA|gh[pousr]_|sk-|xox|{_SECRET_CUE}[\"']? ?[=:]"
#: One of these, or a digit or an at sign, is in every text with an entity.
HINTS = ["AKIA", "ASIA", "sk-", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", *sorted({t for ts in TITLES.values() for t in ts})]
LOWER_HINTS = ["my name is", "name:", "name :", "signed", "regards,", "sincerely,", "contact"]


def hinted(text: Column) -> Column:
    """Whether a text may hold an entity: plain searches are faster than a pattern, and most texts need no further look."""
    low = F.lower(text)
    found = text.rlike("[0-9@]")
    for h in HINTS:
        found = found | text.contains(h)
    for h in LOWER_HINTS:
        found = found | low.contains(h)
    return found


def entities_of(text: Column) -> Column:
    """mention, secret (whether it matched as one) of the mentions in their order; none in a null text."""
    found = lambda pattern, group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    plain = F.transform(found(PATTERN, 0), lambda m: F.struct(m.alias("mention"), F.lit(False).alias("secret")))
    marked = F.zip_with(found(PATTERN, 0), found(_SECRET_GROUP, 1), lambda m, s: F.struct(m.alias("mention"), (s != "").alias("secret")))
    return F.coalesce(F.when(hinted(text), F.when(text.rlike(_SECRET_HINT), marked).otherwise(plain)), F.array().cast("array<struct<mention:string,secret:boolean>>"))


def kind_of(mention: Column) -> Column:
    """The kind of a mention that isn't a secret, by its own form."""
    return (
        F.when(mention.contains("@"), "email")
        .when(mention.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(mention.rlike(r"^[0-9A-Fa-f]{1,4}:"), "ip6")
        .when(mention.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(mention.rlike(r"^\+|^\(|^[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}$"), "phone")
        .when(mention.rlike(r"^[0-9][0-9 \-]{11,26}$"), "card")
        .when(mention.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), "iban")
        .otherwise("name")
    )


def _ip6_groups(mention: Column) -> tuple[Column, Column]:
    """The groups before and after the gap of an address; without a gap all are before it."""
    sides = F.split(mention, "::", 2)
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    return groups(0), groups(1)


def _full_ip6(mention: Column) -> Column:
    before, after = _ip6_groups(F.lower(mention))
    gap = F.array_repeat(F.lit("0"), 8 - F.size(before) - F.size(after))
    return F.array_join(F.transform(F.concat(before, gap, after), lambda g: F.lpad(g, 4, "0")), ":")


def canonical(kind: Column, mention: Column) -> Column:
    """Equal for mentions of one entity: an address in lower case, digits without grouping, a family name."""
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("card", "ssn", "phone"), F.regexp_replace(mention, "[^0-9+]", ""))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind == "ip6", _full_ip6(mention))
        .when(kind == "name", F.regexp_extract(mention, rf"({_NAME})$", 1))
        .otherwise(mention)
    )


def _noise(key: str, kind: Column, value: Column, draw: Column) -> Column:
    """64 hex digits that the key, the entity and the draw decide."""
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, value, draw.cast("string")), 256)


def _digits(noise: Column) -> Column:
    """48 decimal digits: three from every four hex digits, whose bias is under a hundredth."""
    return F.concat(*[F.lpad((F.conv(F.substring(noise, i, 4), 16, 10).cast("int") % 1000).cast("string"), 3, "0") for i in range(1, 65, 4)])


def _poured(template: Column, digits: Column, first: int = 0) -> Column:
    """``template`` with its digits replaced in order; the first ``first`` digits stay."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        is_digit = (c >= "0") & (c <= "9") & (F.octet_length(c) == 1)
        new = F.when(is_digit & (s["n"] >= first), F.substring(digits, s["n"] % 48 + 1, F.lit(1))).otherwise(c)
        return F.struct(F.concat(s["out"], new).alias("out"), (s["n"] + is_digit.cast("int")).alias("n"))

    return F.aggregate(F.split(template, ""), state, step, lambda s: s["out"])


def _luhn(number: Column) -> Column:
    """The digit that completes ``number``, which lacks its last one."""
    n = F.length(number)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = d * 2
        return s + F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return ((10 - F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10) % 10).cast("string")


#: Syllables of made-up names and their endings, by script and gender.
SYLLABLES = {
    "latin": (["Bel", "Cor", "Dan", "Fen", "Gar", "Hol", "Jor", "Kel", "Lam", "Mar", "Nor", "Pel", "Ros", "Sol", "Tav", "Ver"], ["ba", "de", "ki", "lo", "mi", "na", "ro", "si", "ta", "ve", "wi", "za", "go", "pe", "li", "ma"], {"f": "la", "m": "rik", "n": "len"}, "ner"),
    "cyrillic": (["Бел", "Вор", "Гал", "Дан", "Зор", "Кал", "Лаз", "Мар", "Нов", "Пол", "Рас", "Сол", "Тар", "Фед", "Хор", "Чер"], ["ба", "ве", "ги", "до", "жа", "ки", "ло", "ма", "ни", "по", "ра", "си", "та", "ви", "ле", "не"], {"f": "ла", "m": "мир", "n": "лен"}, "ко"),
}


def _made_name(noise: Column, script: str, ending: Column | str) -> Column:
    """One first syllable and five further ones, 24 bits in all, and an ending."""
    first, further, _, _ = SYLLABLES[script]
    pick = lambda options, i: F.element_at(F.array(*map(F.lit, options)), F.conv(F.substring(noise, i, 1), 16, 10).cast("int") + 1)
    return F.concat(pick(first, 1), *[pick(further, i) for i in range(2, 7)], ending if isinstance(ending, Column) else F.lit(ending))


def gender(mention: Column) -> Column:
    title = F.regexp_extract(mention, rf"^({_TITLE})\b", 1)
    return F.when(title.isin(TITLES["f"]), "f").when(title.isin(TITLES["m"]), "m").otherwise("n")


def given_name(mention: Column) -> Column:
    """The given name of a mention of two names, with the gender that the title tells before it; empty without one."""
    given = F.regexp_extract(mention, rf"({_NAME}) {_NAME}$", 1)
    given = F.when(given.isin(*[t for ts in TITLES.values() for t in ts]), "").otherwise(given)
    return F.when(given == "", "").otherwise(F.concat(gender(mention), given))


def _mapped(e: Column, value: Column, keep: int = 0) -> Column:
    """``value``, letter for letter and digit for digit, but for its first ``keep`` characters."""
    noise = F.concat(e["noise"], e["more"])

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(noise, i % 126 + 1, F.lit(2)), 16, 10).cast("int")
        at = lambda options: F.substring(F.lit(options), n % len(options) + 1, F.lit(1))
        new = (
            F.when(e["hexed"] & c.rlike("[0-9a-f]"), at("0123456789abcdef"))
            .when(c.rlike("[0-9]"), at("0123456789"))
            .when(c.rlike("[A-Z]"), at("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike(r"\p{L}"), at("abcdefghijklmnopqrstuvwxyz"))
            .otherwise(c)
        )
        return F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _email(e: Column) -> Column:
    """An address of the same form, in the case of the mention; nobody can own its top domain."""
    mapped = F.regexp_replace(_mapped(e, e["value"]), r"\.[^.]*$", ".invalid")
    cased = F.zip_with(F.split(mapped, ""), F.split(e["mention"], ""), lambda m, c: F.when(c.rlike(r"\p{Lu}"), F.upper(m)).otherwise(m))
    return F.array_join(cased, "")


def _ip6(e: Column) -> Column:
    """Each digit that isn't 0 becomes another one that isn't, so every way to write the address has its counterpart."""
    noise = e["noise"]
    digit = lambda i: F.substring(F.lit("123456789abcdef"), F.conv(F.substring(noise, i + 1, F.lit(1)), 16, 10).cast("int") % 15 + 1, F.lit(1))
    full = F.array_join(F.transform(F.split(e["value"], ""), lambda c, i: F.when(c.isin("0", ":"), c).otherwise(digit(i))), "")
    before, after = _ip6_groups(e["mention"])
    group = lambda g, at: F.substring(full, (at + 1) * 5 - F.length(g), F.length(g))
    left = F.array_join(F.transform(before, lambda g, i: group(g, i)), ":")
    right = F.array_join(F.transform(after, lambda g, i: group(g, i + 8 - F.size(after))), ":")
    return F.when(e["mention"].contains("::"), F.concat(left, F.lit("::"), right)).otherwise(left)


def _iban(e: Column) -> Column:
    """Country and format stay, and the check digits are those of the new number."""
    country = F.substring(e["value"], 1, 2)
    number = F.substring(_mapped(e, e["value"]), F.lit(5), F.length(e["value"]))
    code = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(F.concat(number, country, F.lit("00")), ""), F.lit(0), lambda r, c: (r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + code(c)) % 97)
    whole = F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), number)
    return F.when(e["mention"].contains(" "), F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")).otherwise(whole)


def _name(e: Column) -> Column:
    """The family name's surrogate after the title and the given name's; a given name's own is led by its gender."""
    made = lambda name, noise, ending: F.when(name.rlike(r"\p{IsCyrillic}"), _made_name(noise, "cyrillic", ending("cyrillic"))).otherwise(_made_name(noise, "latin", ending("latin")))
    g = F.substring(e["given"], 1, 1)
    given_ending = lambda s: F.when(g == "f", SYLLABLES[s][2]["f"]).when(g == "m", SYLLABLES[s][2]["m"]).otherwise(SYLLABLES[s][2]["n"])
    given = F.when(e["given"] == "", "").otherwise(F.concat(_longer(e["given_draw"], e["given_noise"], made(e["given"], e["given_noise"], given_ending)), F.lit(" ")))
    title = F.regexp_extract(e["mention"], rf"^((?:{_TITLE})\.? )", 1)
    return F.concat(title, given, made(e["value"], e["noise"], lambda s: SYLLABLES[s][3]))


def _given(e: Column) -> Column:
    g = F.substring(e["value"], 1, 1)
    ending = lambda s: F.when(g == "f", SYLLABLES[s][2]["f"]).when(g == "m", SYLLABLES[s][2]["m"]).otherwise(SYLLABLES[s][2]["n"])
    return F.concat(g, F.when(e["value"].rlike(r"\p{IsCyrillic}"), _made_name(e["noise"], "cyrillic", ending("cyrillic"))).otherwise(_made_name(e["noise"], "latin", ending("latin"))))


def _longer(draw: Column, noise: Column, made: Column) -> Column:
    """From the draw ``FORM_DRAWS`` on a surrogate has sixteen more characters."""
    return F.when(draw >= FORM_DRAWS, F.concat(made, F.lit("-"), F.substring(noise, 48, 16))).otherwise(made)


def _surrogate(e: Column) -> Column:
    """The surrogate of an entity in the format of ``mention``; of the canonical form it is canonical too."""
    kind, value, mention, noise, digits = (e[x] for x in ("kind", "value", "mention", "noise", "digits"))
    octet = lambda i: (F.conv(F.substring(noise, i, 4), 16, 10).cast("int") % 256).cast("string")
    ip = F.concat_ws(".", (F.lit(240) + F.conv(F.substring(noise, 1, 4), 16, 10).cast("int") % 15).cast("string"), octet(5), octet(9), octet(13))
    number = F.concat(F.substring(value, 1, 1), F.substring(digits, F.lit(1), F.length(value) - 2))
    # the first digit of a country code stays
    phone = F.when(value.startswith("+"), _poured(mention, digits, 1)).otherwise(_poured(mention, digits))
    return (
        F.when(kind == "email", F.when(e["draw"] >= FORM_DRAWS, F.concat(F.substring(noise, 48, 16), F.lit("."), _email(e))).otherwise(_email(e)))
        .when(kind == "ip", _longer(e["draw"], noise, ip))
        .when(kind == "ip6", _longer(e["draw"], noise, _ip6(e)))
        .when(kind == "card", _longer(e["draw"], noise, _poured(mention, F.rpad(F.concat(number, _luhn(number)), 48, "0"))))
        .when(kind == "ssn", _longer(e["draw"], noise, _poured(mention, digits)))
        .when(kind == "phone", _longer(e["draw"], noise, phone))
        .when(kind == "iban", _longer(e["draw"], noise, _iban(e)))
        .when(kind == "name", _longer(e["draw"], noise, _name(e)))
        .when(kind == "given", _longer(e["draw"], noise, _given(e)))
        .when(kind == "secret", _longer(e["draw"], noise, F.when(value.rlike("^(?:AKIA|ASIA)"), _mapped(e, value, 4)).otherwise(_mapped(e, value))))
        .otherwise(mention)
    )


def _more(e: Column, names: list[str], **new: Column) -> Column:
    return F.struct(*[e[x].alias(x) for x in names], *[v.alias(k) for k, v in new.items()])


def described(mentions: Column) -> Column:
    """mention, kind, value, given (of names) of each mention; of a number that only looks like a card's the kind is ``none``."""
    kinds = F.transform(mentions, lambda m: F.struct(m["mention"].alias("mention"), F.when(m["secret"], "secret").otherwise(kind_of(m["mention"])).alias("kind")))
    given = lambda e: F.when(e["kind"] == "name", given_name(e["mention"])).otherwise("")
    valued = F.transform(kinds, lambda e: _more(e, ["mention", "kind"], value=canonical(e["kind"], e["mention"]), given=given(e)))
    wrong = lambda e: (e["kind"] == "card") & (_luhn(F.substring(e["value"], F.lit(1), F.length(e["value"]) - 1)) != F.substring(e["value"], -1, 1))
    return F.transform(valued, lambda e: _more(e, ["mention", "value", "given"], kind=F.when(wrong(e), "none").otherwise(e["kind"])))


def surrogates(entities: Column, key: str) -> Column:
    """Surrogates of an array of (mention, kind, value, given, draw, given_draw); step by step, so that each noise is made once."""
    base = ["mention", "kind", "value", "given", "draw", "given_draw"]
    given = lambda e: F.when(e["given"] != "", _noise(key, F.lit("given"), e["given"], e["given_draw"]))
    noisy = F.transform(entities, lambda e: _more(e, base, noise=_noise(key, e["kind"], e["value"], e["draw"]), given_noise=given(e), hexed=e["value"].rlike("^[0-9]*[a-f][0-9a-f]*$")))
    full = F.transform(noisy, lambda e: _more(e, [*base, "noise", "given_noise", "hexed"], more=F.sha2(e["noise"], 256), digits=_digits(e["noise"])))
    return F.transform(full, _surrogate)


def corpus_entities(docs: DataFrame) -> DataFrame:
    """kind, value of all distinct entities of ``docs``; a name's given name is one of its own."""
    found = once(docs.select(F.col("text").cast("string").alias("text")), "mentions", entities_of(F.col("text"))).where(F.size("mentions") > 0)
    every = found.select(F.explode(described(F.array_distinct("mentions"))).alias("e")).where("e.kind <> 'none'")
    both = F.array(F.struct("e.kind", "e.value"), F.struct(F.lit("given").alias("kind"), F.col("e.given").alias("value")))
    return every.select(F.explode(both).alias("x")).select("x.kind", "x.value").where("value <> ''").distinct()


def further_draws(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, draw of the entities whose first surrogate is another's, or an entity of the corpus.

    ``entities`` has distinct kind, value.  A surrogate that several entities
    drew goes to the smallest of them.  Rounds go on until none collides: from
    the draw ``FORM_DRAWS`` on surrogates are longer, by 64 bits of the key's
    noise, so that the next round or the one after it is the last.
    """
    pending, settled = entities.withColumn("draw", F.lit(0)), None
    while True:
        one = F.struct(F.col("value").alias("mention"), "kind", "value", F.lit("").alias("given"), "draw", F.lit(0).alias("given_draw"))
        drawn = once(pending, "made", F.get(surrogates(F.array(one), key), F.lit(0)))
        drawn = written(drawn.select("kind", "value", "draw", F.when(F.col("kind") == "email", F.lower("made")).otherwise(F.col("made")).alias("made")))
        taken = entities.select("kind", F.col("value").alias("made"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "made")).distinct()
        free = drawn.join(taken, ["kind", "made"], "left_anti")
        winners = free.groupBy("kind", "made").agg(F.min("value").alias("value")).join(drawn.select("kind", "value", "draw"), ["kind", "value"])
        won = written(winners.select("kind", "value", "draw", "made"))
        settled = won if settled is None else settled.union(won)
        pending = written(drawn.join(won, ["kind", "value"], "left_anti").select("kind", "value", (F.col("draw") + 1).alias("draw")))
        if pending.isEmpty():
            return written(settled.where("draw > 0").select("kind", "value", "draw"))


def replace_pii(docs: DataFrame, *, key: str, table_rows: int = TABLE_ROWS) -> DataFrame:
    """``docs`` with surrogates in ``text``, n_entities and kinds (sorted); n_chars, if there, is set anew.

    One entity has one surrogate in the whole corpus, different entities have
    different ones, and none is an entity of the corpus.  Where a form has too
    few surrogates for that (secrets of eight characters but for one digit),
    some get longer ones.  Texts without entities are returned as they are;
    null and empty texts stay so with no entities.  Null ids and repeated rows
    are handled like any other, other columns pass; where ``docs`` has
    n_entities or kinds, the new ones get an underscore before their name.
    """
    again = further_draws(written(corpus_entities(docs)), key)
    n = again.count()
    found_name = free_name(docs, "found")
    found = once(docs, found_name, described(entities_of(F.col("text").cast("string"))))
    if n and n <= table_rows:
        buckets = buckets_for(n)
        table = lookup_table(again.select(F.concat_ws("\u0001", "kind", "value").alias("id"), "draw"), "id", buckets)

        def draw(kind: Column, value: Column) -> Column:
            name = F.concat_ws("\u0001", kind, value)
            rows = F.filter(F.coalesce(F.element_at(table, bucket(name, buckets)), F.array()), lambda r: r["id"] == name)
            return F.coalesce(F.get(rows, F.lit(0))["draw"], F.lit(0))

    elif n:
        found, draws = _joined_draws(found, found_name, again)

        def draw(kind: Column, value: Column) -> Column:
            return F.coalesce(F.get(F.filter(draws, lambda r: (r["kind"] == kind) & (r["value"] == value)), F.lit(0))["draw"], F.lit(0))

    else:

        def draw(kind: Column, value: Column) -> Column:
            return F.lit(0)

    given_draw = lambda e: F.when(e["given"] != "", draw(F.lit("given"), e["given"])).otherwise(0)
    drawn = F.transform(found_name, lambda e: _more(e, ["mention", "kind", "value", "given"], draw=draw(e["kind"], e["value"]), given_draw=given_draw(e)))
    made = surrogates(drawn, key)
    text = F.array_join(F.zip_with(F.split("text", PATTERN, -1), made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    real = F.filter(found_name, lambda e: e["kind"] != "none")
    any_found = F.size(real) > 0
    new_text = free_name(found, "new_text")
    out = once(found, new_text, F.when(any_found, text).otherwise(F.col("text")))
    changed = {"text": F.col(new_text)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(any_found, F.char_length(new_text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    kept = [changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]
    kinds = F.array_sort(F.array_distinct(F.transform(real, lambda e: e["kind"])))
    return out.select(*kept, F.size(real).cast("long").alias(free_name(docs, "n_entities")), kinds.alias(free_name(docs, "kinds")))


def _joined_draws(found: DataFrame, mentions: str, again: DataFrame) -> tuple[DataFrame, Column]:
    """``found`` with the further draws among its entities, for a table of any size, and their column."""
    draws = free_name(found, "draws")
    rows = found.where(F.size(mentions) > 0).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("name"), F.explode(mentions).alias("e"))
    both = F.array(F.struct("e.kind", "e.value"), F.struct(F.lit("given").alias("kind"), F.col("e.given").alias("value")))
    pairs = rows.select("id", "name", F.explode(both).alias("x")).select("id", "name", "x.kind", "x.value").distinct()
    met = pairs.join(again, ["kind", "value"]).groupBy("id", "name").agg(F.collect_list(F.struct("kind", "value", "draw")).alias("met"))
    same = F.col("f.doc_id").eqNullSafe(F.col("m.id")) & (F.xxhash64("f.text") == F.col("m.name"))
    joined = found.alias("f").join(met.alias("m"), same, "left")
    return joined.select("f.*", F.coalesce("m.met", F.array().cast("array<struct<kind:string,value:string,draw:int>>")).alias(draws)), F.col(draws)
