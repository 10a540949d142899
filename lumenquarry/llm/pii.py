"""Personal data replaced by surrogates, in DataFrame functions only (operator 3).

*Detection.* One pattern finds e-mail addresses, IPv4 addresses, payment cards, phone numbers, social security numbers, IBANs,
access keys and secrets after a name such as ``password=`` (to their end), and names after a title (Latin and Cyrillic; all
name words that follow), with the other mentions of these words in the same text.

*Surrogates.* sha2 of (key, kind, normal form, round) gives the characters: a digit for a digit, a letter for a letter of
the same case, script and kind (vowel or not), marks as they are. Kinds keep what makes them one: an e-mail
address its shape and a reserved domain, a phone number its country code, a card its first digit and, if valid, its
check digit, an IBAN its country and valid check digits, an access key its prefix; IPv4 addresses go to the reserved
240.0.0.0/4, social security numbers to the 9xx area that is never given out. Titles stay, and a name's last vowel, which
marks its gender, stays; so does a last consonant as a consonant, whoever the name belongs to. The normal form leaves out case and punctuation, so all spellings of an entity, in
all documents, get the same characters in their own format.

*Collisions.* All distinct entities of the table are collected in a written table; of those whose surrogates are equal, or
equal to an entity of the table, all but the smallest are drawn again in the next round, until none is left. Only
those drawn again need to be known when texts are rewritten: a map in the plan up to IN_PLAN of them, else a join by text.

Null and empty texts stay as they are. Secrets of fewer than 6 characters aren't detected.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save, shielded

IN_PLAN, ROUNDS = 5_000, 40
CODE_KEPT = 20  # draws of a phone number that keep its country code

#: Titles that stand before names.
TITLES = (
    "Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа", "г-жа", "Dr", "Prof", "Professor",
)

_TITLE = "(?:" + "|".join(TITLES) + r")\.? "
_SECRET = r"""(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]|[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Pp][Ww][Dd])["']?\s{0,2}[=:]\s{0,2}["']?"""
#: The country codes of one and two digits; all others have three.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё"
_CAPITAL = "A-ZÀ-ÖØ-ÞА-ЯЁ"
#: A name's word: inner capitals, hyphens before a capital, apostrophes but those of 's, 'll and the like; no title, secret or address.
_WORD = (
    rf"(?!{_TITLE}|{_SECRET}|[A-Za-z0-9._%+-]{{1,64}}@)[{_CAPITAL}](?:[{_LETTER}]|-(?=[{_CAPITAL}])|['’](?=[{_LETTER}])(?!(?:s|d|m|t|ll|ve|re)(?![{_LETTER}])))++(?![0-9_])"
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERN = "(?<![A-Za-z0-9])(?:" + "|".join((
    _SECRET + r"""[^\s"'=:<>][^\s"'<>]{5,}+""",
    r"(?<![._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    r"[3-6]\d{3}(?:[ -]?\d{4}){3}(?![\dA-Za-z])",
    r"3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\dA-Za-z])",
    r"(?<!\+)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    r"(?<!\()\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)",
    r"(?<![.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])",
    r"(?<!-)\d{3}-\d{2}-\d{4}(?![\w-])",
    r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    rf"{_TITLE}{_WORD}(?: {_WORD})*+",
)) + ")"
MARK = "\ufdd0"  # a noncharacter: texts that hold it take the way with two passes of the pattern


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kind_of(found: Column) -> Column:
    return (
        F.when(found.rlike(f"^{_SECRET}"), "secret")
        .when(found.contains("@"), "email")
        .when(found.rlike(f"^{_TITLE}"), "name")
        .when(found.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ipv4")
        .when(found.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(found.rlike(r"^\d{3}[-.]\d{3}[-.]\d{4}$") | found.rlike(r"^[+(]"), "phone")
        .when(found.rlike(r"^[0-9 -]+$"), "card")
        .when(found.rlike(r"^(?:AKIA|ASIA)"), "access_key")
        .otherwise("iban")
    )


def units(found: Column) -> Column:
    """What is replaced of a match, in order: before (kept), kind, found."""
    one = lambda before, kind, part: F.struct(before.alias("before"), kind.alias("kind"), part.alias("found"))

    def of(kind):
        head = F.regexp_extract(found, f"^(?:{_SECRET}|{_TITLE})", 0)
        words = lambda head: F.transform(F.split(F.substring(found, F.length(head) + 1, F.length(found)), " "), lambda w, i: one(F.when(i == 0, head).otherwise(F.lit(" ")), kind, w))
        return F.when(kind == "secret", let(head, lambda h: F.array(one(h, kind, F.substring(found, F.length(h) + 1, F.length(found)))))).when(kind == "name", let(head, words)).otherwise(F.array(one(F.lit(""), kind, found)))

    return let(kind_of(found), of)


def normal_form(kind: Column, found: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(found))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(found, "[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(found, " ", ""))
        .otherwise(found)
    )


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _number(digest: Column, i: Column) -> Column:
    """Two hex digits of the digest as a number; the digest goes round."""
    return F.conv(F.substring(digest, (i * 2) % 62 + 1, F.lit(2)), 16, 10).cast("int")


#: Of each script and case: letters that count as vowels, all letters (a range), and what vowels and others become.
LETTERS = (
    ("aeiouy", "a", "z", "aeiou", "bcdfghklmnprstvz"),
    ("AEIOUY", "A", "Z", "AEIOU", "BCDFGHKLMNPRSTVZ"),
    ("аеёиоуыэюя", "а", "ё", "аеиоу", "бвгдзклмнпрст"),
    ("АЕЁИОУЫЭЮЯ", "Ё", "Я", "АЕИОУ", "БВГДЗКЛМНПРСТ"),
    ("ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ß", "ÿ", "àâéèêîôû", "ç"),
    ("ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ", "À", "Þ", "ÀÂÉÈÊÎÔÛ", "Ç"),
)


def _letters(text: Column, digest: Column) -> Column:
    """text with each digit and letter drawn anew."""

    def draw(c, i):
        def one(n):
            out = F.when((c >= "0") & (c <= "9"), (n % 10).cast("string"))
            for vowels, lo, hi, new, others in LETTERS:
                is_vowel = F.instr(F.lit(vowels), c) > 0
                out = out.when((c >= lo) & (c <= hi), F.when(is_vowel, F.substring(F.lit(new), n % len(new) + 1, F.lit(1))).otherwise(F.substring(F.lit(others), n % len(others) + 1, F.lit(1))))
            return out.otherwise(c)

        return let(_number(digest, i), one)

    return F.array_join(F.transform(_chars(text), draw), "")


def _digits(digest: Column, n: int = 32) -> Column:
    """Decimal digits of a digest."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (_number(digest, i) % 10).cast("string")), "")


def _fill(shape: Column, text: Column, moves: str) -> Column:
    """shape with its characters that match moves, in order, from text."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(a, c):
        taken = F.struct(F.concat(a["out"], F.substring(text, a["k"] + 1, F.lit(1))).alias("out"), (a["k"] + 1).alias("k"))
        return F.when(c.rlike(moves), taken).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["k"].alias("k")))

    return F.aggregate(_chars(shape), start, step, lambda a: a["out"])


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's check over digits whose last is the check digit."""
    each = F.transform(F.reverse(_chars(digits)), lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: F.when(c <= "9", (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def surrogate(kind: Column, found: Column, key: str, times: Column) -> Column:
    """The replacement of an entity, in the format it was found in, after `times` draws."""
    sha = lambda *x: F.sha2(F.concat_ws("\x1f", F.lit(key), *x), 256)

    def email(digest):
        local, domain = F.substring_index(found, "@", 1), F.lower(F.substring_index(found, "@", -1))
        top = F.when(domain.rlike(r"\.(?:com|net|org)$"), F.substring_index(domain, ".", -1)).otherwise(F.lit("org"))
        host = F.regexp_replace(domain, r"(?:(?:^|\.)example)?\.[a-z0-9-]+$", "")
        hosted = F.when(host == "", F.lit("")).otherwise(F.concat(_letters(host, sha(F.lit("domain"), domain)), F.lit(".")))
        return F.concat(_letters(local, digest), F.lit("@"), hosted, F.lit("example."), top)

    def ipv4(digest):
        octet = lambda i, lo, n: (F.lit(lo) + F.conv(F.substring(digest, 3 * i + 1, 3), 16, 10).cast("int") % n).cast("string")
        return F.concat_ws(".", octet(0, 240, 15), octet(1, 0, 256), octet(2, 0, 256), octet(3, 1, 254))

    def phone(digest):
        """The code comes from the normal form, so all spellings, and the check of collisions, draw the same digits."""
        code = F.when(times < CODE_KEPT, F.regexp_extract(normal_form(kind, found), _COUNTRY, 1)).otherwise(F.lit(""))  # short numbers run out
        return _fill(found, F.concat(code, _digits(digest)), "[0-9]")

    def card(digest):
        def of(bare, new):
            check = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: _luhn(F.concat(new, d.cast("string"))) % 10)
            last = F.when(_luhn(bare) % 10 == 0, (F.array_position(check, F.lit(0)) - 1).cast("string")).otherwise((_number(digest, F.lit(30)) % 10).cast("string"))
            return _fill(found, F.concat(new, last), "[0-9]")

        return let(F.regexp_replace(found, "[^0-9]", ""), lambda bare: let(F.concat(F.substring(bare, 1, 1), F.substring(_digits(digest), F.lit(1), F.length(bare) - 2)), lambda new: of(bare, new)))

    def iban(digest):
        bare = F.regexp_replace(found, " ", "")
        land = F.substring(bare, 1, 2)
        check = lambda body: F.lpad((98 - _mod97(F.concat(body, land, F.lit("00")))).cast("string"), 2, "0")
        return let(_letters(F.substring(bare, 5, 40), digest), lambda body: _fill(found, F.concat(land, check(body), body), "[^ ]"))

    def secret(digest):
        block = F.concat(digest, *(F.sha2(F.concat(digest, F.lit(str(i))), 256) for i in range(3)))
        hexes = F.repeat(block, F.ceil(F.length(found) / 256).cast("int"))
        return F.when(found.rlike("^[0-9a-f]{8,}$"), F.substring(hexes, F.lit(1), F.length(found))).otherwise(_letters(found, digest))

    def name(digest):
        stem = F.regexp_replace(found, ".$", "")
        more = F.substring(F.lit("ovelinaro"), F.lit(1), F.least(F.floor(times / 4).cast("int"), F.lit(9)))  # short names run out
        end = F.regexp_extract(found, ".$", 0)
        kept = F.when(end.rlike("[aeiouyаеёиоуыэюя]"), end).otherwise(_letters(end, F.reverse(digest)))
        return F.concat(_letters(F.concat(stem, more), digest), kept)

    def of(digest):
        return (
            F.when(kind == "email", email(digest)).when(kind == "ipv4", ipv4(digest)).when(kind == "phone", phone(digest)).when(kind == "card", card(digest))
            .when(kind == "ssn", _fill(found, F.concat(F.lit("9"), _digits(digest)), "[0-9]")).when(kind == "iban", iban(digest))
            .when(kind == "access_key", F.concat(F.substring(found, 1, 4), _letters(F.substring(found, 5, 60), digest)))
            .when(kind == "secret", secret(digest)).otherwise(name(digest))
        )

    return let(sha(kind, normal_form(kind, found), times.cast("string")), of)


def with_bare_names(found: DataFrame) -> DataFrame:
    """found (__parts, and __e of the matches between them) with the other mentions of each text's detected names as matches too."""
    words = F.array_distinct(F.transform(F.filter(F.flatten("__e"), lambda e: e["kind"] == "name"), lambda e: e["found"]))
    longest = F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    one = F.concat(F.lit(rf"(?<![{_LETTER}0-9_])(?:"), F.array_join(longest, "|"), F.lit(rf")(?![{_LETTER}0-9_])"))  # names hold letters, hyphens and apostrophes only
    found = found.withColumn("__bare", F.when(F.size(words) > 0, one))
    mention = lambda w: F.array(F.struct(F.lit("").alias("before"), F.lit("name").alias("kind"), w.alias("found")))
    matches = lambda p, i: F.concat(F.transform(F.regexp_extract_all(p, F.col("__bare"), F.lit(0)), mention), F.slice("__e", i + 1, F.lit(1)))
    named = F.col("__bare").isNotNull()
    return found.withColumns({
        "__parts": F.when(named, F.flatten(F.transform("__parts", lambda p: F.split(p, F.col("__bare"), -1)))).otherwise(F.col("__parts")),
        "__e": F.when(named, F.flatten(F.transform("__parts", matches))).otherwise(F.col("__e")),
    })


def entities(docs: DataFrame, text: str) -> DataFrame:
    """kind, normal: the distinct entities of all texts."""
    found = F.explode(F.flatten(F.transform(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)), units)))
    each = docs.select(found.alias("e")).select(F.col("e.kind").alias("kind"), F.col("e.found").alias("found"))
    return each.select("kind", normal_form(F.col("kind"), F.col("found")).alias("normal")).distinct()


def drawn_again(own: DataFrame, drawing: Column) -> DataFrame:
    """kind, normal, times: of own (kind, normal; a written table) those whose first surrogate would collide, and the draw that doesn't.

    drawing: __new (the surrogates) of __e, an array of before, kind, found, times."""

    def draw(rows: DataFrame, times: int) -> DataFrame:
        one = F.array(F.array(F.struct(F.lit("").alias("before"), "kind", F.col("normal").alias("found"), F.lit(times).alias("times"))))
        made = rows.select("kind", "normal", one.alias("__e")).select("kind", "normal", F.lit(times).alias("times"), drawing.alias("__new"))
        return save(made.select("kind", "normal", "times", normal_form(F.col("kind"), F.get("__new", F.lit(0))).alias("new")), "pii_surrogates")

    first = made = draw(own, 0)
    settled: list[DataFrame] = []
    written = [first]
    for times in range(ROUNDS):
        twice = made.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("normal").alias("least")).where("n > 1").select("kind", "new", "least")
        clash = made.join(twice, ["kind", "new"]).where(F.col("normal") != F.col("least")).select("kind", "normal")
        for taken in (own.select("kind", F.col("normal").alias("new")), *(x.select("kind", "new") for x in ([first, *settled] if times else []))):
            clash = clash.unionAll(made.join(taken, ["kind", "new"], "left_semi").select("kind", "normal"))
        clash = save(clash.distinct(), "pii_clash")
        written.append(clash)
        if times:
            settled.append(save(made.join(clash, ["kind", "normal"], "left_anti"), "pii_settled"))
        if clash.isEmpty():
            break
        made = draw(clash, times + 1)
        written.append(made)
    else:
        raise ValueError(f"entities without a surrogate of their own after {ROUNDS} draws")
    out = own.select("kind", "normal", F.lit(0).alias("times")).limit(0)
    for s in settled:
        out = out.unionAll(s.select("kind", "normal", "times"))
    out = save(out, "pii_drawn_again")
    discard(*written, *settled)
    return out


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with surrogates in place of personal data, and __kinds (the kinds of the entities replaced, in order; a column of that name goes)."""
    return shielded(docs.select(*(c for c in map("`{}`".format, docs.columns) if c != "`__kinds`")), lambda own, name: _replace(own, key, name[text]))


def _replace(docs: DataFrame, key: str, text: str) -> DataFrame:
    names = docs.columns
    new = lambda e: F.concat(e["before"], surrogate(e["kind"], e["found"], key, e["times"]))
    drawing = F.transform(F.col("__e"), lambda match: F.array_join(F.transform(match, new), ""))
    own = save(entities(docs, text), "pii_entities")
    again = drawn_again(own, drawing)
    discard(own)
    marked = F.split(F.regexp_replace(F.col(text), PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    every = lambda x, rest: F.filter(x, lambda _, i: i % 2 == rest)
    odd = F.col(text).contains(MARK)
    found = docs.withColumn("__marked", F.when(~odd, marked))
    found = found.withColumns({
        "__parts": F.when(odd, F.split(F.col(text), PATTERN, -1)).otherwise(every("__marked", 0)),
        "__e": F.transform(F.when(odd, F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).otherwise(every("__marked", 1)), units),
    })
    found = with_bare_names(found)
    id_ = lambda k, f: F.concat(k, F.lit("\x1f"), normal_form(k, f))
    times = lambda e: F.lit(0)
    if (n := again.limit(IN_PLAN + 1).count()) and n <= IN_PLAN:
        known = {f"{r.kind}\x1f{r.normal}": r.times for r in again.collect()}
        found = found.withColumn("__times", F.from_json(F.lit(json.dumps(known)), "map<string,int>"))
    elif n:
        sha = F.sha2(F.col(text), 256)
        each = found.select(sha.alias("__sha"), F.explode(F.flatten("__e")).alias("e")).select("__sha", id_(F.col("e.kind"), F.col("e.found")).alias("id")).distinct()
        listed = again.select(F.concat_ws("\x1f", "kind", "normal").alias("id"), "times")
        maps = each.join(listed, "id").groupBy("__sha").agg(F.map_from_entries(F.collect_list(F.struct("id", "times"))).alias("__times"))  # of one text each
        found = found.withColumn("__sha", sha).join(maps, "__sha", "left")
    if n:
        times = lambda e: F.coalesce(F.try_element_at(F.col("__times"), id_(e["kind"], e["found"])), F.lit(0))
    timed = lambda e: F.struct(e["before"].alias("before"), e["kind"].alias("kind"), e["found"].alias("found"), times(e).alias("times"))
    found = found.withColumn("__kinds", F.transform(F.flatten("__e"), lambda e: e["kind"])).withColumn("__e", F.transform("__e", lambda m: F.transform(m, timed)))
    found = found.withColumn("__new", drawing)
    whole = F.when(F.size("__e") > 0, F.array_join(F.zip_with("__parts", "__new", lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")).otherwise(F.col(text))
    return found.withColumn(text, whole).select(*names, "__kinds")
