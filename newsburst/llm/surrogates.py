"""Personal data replaced by surrogates: detected entities get keyed replacements of the same
kind, gender, script and format, alike wherever the same entity occurs, and distinct for distinct
entities.

1. Patterns find entities; each has a normal form (digits of a phone or card number, a lower-cased
   address), so spellings of one entity share a surrogate. A person is one form per word of the name,
   so "Mr John Smith" and "Mr Smith" share the surname. Documents with entities are staged.
2. The distinct normal forms of the whole table get candidates, keyed digests shaped like the
   form. A candidate that another form also has, or that is itself a form found in the texts, is a
   collision: one form keeps a shared candidate, the others try the next. Rounds go on until none
   is open, each a written table.
3. Documents with entities join their forms' surrogates and are put together again, each
   occurrence in its own layout. Other documents pass through in place.

All of it is DataFrame expressions. Occurrences are made distinct before they are shuffled, texts
join on a hash of the text, and a frequent entity is one row of the table of forms.

Found are only the written forms of ``PATTERNS``: a person behind a title, and that name where it comes
again in the same text; not names without a title, street addresses, numbers of other countries'
national forms. Spellings of one IPv6 address other than in case are separate, and so are a national
number and its international form, except with +1. Equal names of a man and a woman are separate, as
the surrogates match the gender.

What is no name, although it is capitalised: an office behind a title; a word of ``NO_NAMES``, or a noun
that stands behind a German article in the text, as second name or as later mention; a month before a
number as second name, and any month or weekday as later mention; a later mention that begins a
sentence, where the text has the word in small letters too. Cards get a valid Luhn digit, IBANs valid check digits.

Defined results: null and empty texts stay as they are. Repeated rows, and rows that share an id
or have none, are treated alike. Entities of one normal form in several kinds are separate. An empty table
gives none. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsburst.llm.common import fresh
from newsburst.session import stage

ROUNDS = 64

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_MALE, _FEMALE = "Mr|Herr|Monsieur|Señor|Г-н", "Mrs|Ms|Miss|Frau|Mme|Mlle|Señora|Г-жа"
_HEX = "[0-9A-Fa-f]{1,4}"
_IBAN = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR|UA"
#: Offices that follow a title, words that begin sentences, days and months, German articles.
OFFICES = (
    "Minister Ministerin Präsident Präsidentin Kanzler Kanzlerin Bürgermeister Bürgermeisterin Doktor Professor Professorin "
    "Direktor Direktorin Abgeordneter Abgeordnete Vorsitzender Vorsitzende President Speaker Chairman Chairwoman Secretary "
    "Ministre Président Présidente Directeur Directrice Presidente Presidenta Ministro Ministra Alcalde Президент Министр"
).split()
NO_NAMES = (
    "The This That These Those There Then They He She It We You His Her Their But And However When While After Before Yesterday "
    "Today Tomorrow Der Die Das Dies Diese Dieser Er Sie Es Wir Ihr Aber Und Doch Dann Da Gestern Heute Nun Später Nach Vor Alle "
    "Le La Les Il Elle Ils Elles Mais Puis Hier Demain El Ella Los Las Pero Ayer Hoy Он Она Они Но Вчера Сегодня Завтра Потом"
).split()
DAYS = (
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag "
    "January February March April May June July August September October November December "
    "Januar Februar März Mai Juni Juli Oktober Dezember"
).split()
ARTICLES = "der die das dem den des ein eine einen einem einer eines kein keine keinen alle allen Der Die Das Ein Eine Alle Kein Keine".split()

_OFFICE, _NO_NAME, _DAY = "|".join(OFFICES), "|".join(NO_NAMES), "|".join(DAYS)
_NAME = rf"(?!(?:{_OFFICE})(?!\p{{L}}))\p{{Lu}}(?:[\p{{L}}-]|['’](?!s(?!\p{{L}})))+"
_SECOND = rf"(?!(?:{_NO_NAME})(?!\p{{L}})|(?:{_DAY})(?!\p{{L}}) ?\d){_NAME}"
#: What precedes the name in a person: the title, and an office that is kept.
_LEAD = rf"^(?:{_MALE}|{_FEMALE})\.? (?:(?:{_OFFICE}) )?"
_NOUN = rf"(?<!\p{{L}})(?:{'|'.join(ARTICLES)}) (\p{{Lu}}[\p{{L}}-]+)"

#: Kinds in the order in which they are tried at a place.
PATTERNS = {
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_MALE}|{_FEMALE})\.? (?:(?:{_OFFICE}) )?{_NAME}(?: {_SECOND})?",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,60})(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?=\d*[a-f])(?=[a-f]*\d)[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "iban": rf"(?<![0-9A-Za-z])(?:(?:{_IBAN})\d{{2}}(?=(?:[ A-Z]*\d){{6}})(?:(?: ?[0-9A-Z]{{4}}){{3,7}}(?: ?[0-9A-Z]{{1,3}})?|(?: ?[0-9A-Z]{{4}}){{2}} ?[0-9A-Z]{{3}})"
    r"|[A-Z]{2}\d{2}(?: ?\d{4}){3,6}(?: ?\d{1,4})?)(?![0-9A-Za-z])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:])",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
    r"|\+\d{1,3}(?:[ .-]?\d{1,4}){1,2}(?:[ .-]?\d{2,4}){2,4}|(?<![\d.,])(?:\d{3} \d{3} \d{4}|0[1-9](?:[ .-]?\d{2}){4}"
    r"|0[1-9]\d{1,3}[ /-]\d{5,9}|[6-9]\d{2}(?: \d{2}){3}))(?!\d)",
    "card": r"(?<![\d+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)",
}
PATTERN = "|".join(PATTERNS.values())
#: An entity holds a digit, an at sign or one of these: a quick look that spares most texts the patterns.
TRIGGERS = [*_MALE.split("|"), *_FEMALE.split("|"), "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"]
_WITH_ONE = r"^\+1(?:\D*\d){10}$"
DIGIT_KINDS = ("phone", "card", "ssn")
GENDERS = ("male", "female")

#: Syllables of made-up names by script (fixed values), and endings by gender.
SYLLABLES = {
    "latin": "ba do fe ga hi ja ko le mi na ro sa te va wi zu".split(),
    "cyrillic": "ба до фе га ки ла мо ни па ро са те ва зи лу ми".split(),
}
ENDINGS = {"latin": {"male": "rd", "female": "ra"}, "cyrillic": {"male": "ов", "female": "ова"}}


def may_hold(text: Column) -> Column:
    """False only where ``PATTERN`` cannot match."""
    hint = text.rlike("[0-9@]")
    for trigger in TRIGGERS:
        hint = hint | F.contains(text, F.lit(trigger))
    return F.coalesce(hint, F.lit(False))


def kind_of(entity: Column) -> Column:
    # Only an IBAN's pattern looks at what follows it, and so may not match alone.
    kind = F.lit("iban")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def normal_form(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        F.when((kind == "phone") & entity.rlike(_WITH_ONE), F.substring(digits, 2, 10))
        .when(kind.isin(*DIGIT_KINDS), digits)
        .when(kind.isin("email", "ip6"), F.lower(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .otherwise(entity)
    )


def is_person(entity: Column) -> Column:
    """Of the entities found only a person begins with a title and a space."""
    return entity.rlike(_LEAD)


def name_words(person: Column) -> Column:
    return F.split(F.regexp_replace(person, _LEAD, ""), " ")


def parts(kind: Column, entity: Column, nouns: Column) -> Column:
    """The forms of an entity as (place, kind, form): one, or each word of a person's name with the gender
    for kind, but no second word that is one of ``nouns``."""
    gender = F.when(entity.rlike(f"^(?:{_FEMALE})\\.? "), "female").otherwise("male")
    words = F.transform(
        name_words(entity), lambda w, i: F.struct(i.alias("place"), gender.alias("kind"), w.alias("form"))
    )
    named = F.filter(words, lambda w: (w["place"] == 0) | ~F.array_contains(nouns, w["form"]))
    single = F.struct(F.lit(0).alias("place"), kind.alias("kind"), normal_form(kind, entity).alias("form"))
    return F.when(kind == "person", named).otherwise(F.array(single))


def _digest(key: str, *parts: Column) -> Column:
    """64 hex digits of a keyed hash, the key inside and outside."""
    inner = F.sha2(F.concat_ws("\n", F.lit(key), *parts), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _shaped(form: Column, digest: Column) -> Column:
    """``form`` with letters and digits replaced, class for class."""
    digits = F.translate(digest, "abcdef", "391746")
    letters = F.translate(digest, "0123456789abcdef", "etaoinshrdlucmfw")

    def change(c, i):
        at = F.pmod(i, F.lit(64)) + 1
        low = F.substring(letters, at, F.lit(1))
        return (
            F.when(c.between("0", "9"), F.substring(digits, at, F.lit(1)))
            .when(c.between("A", "Z"), F.upper(low))
            .when(c.rlike(r"\p{L}"), low)
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(form, ""), change), "")


def _made_up_name(kind: Column, form: Column, digest: Column, attempt: Column) -> Column:
    """A word of a name in the form's script with the ending of the gender."""
    places = F.sequence(F.lit(1), 3 + F.least(attempt, F.lit(12)))

    def named(script):
        listed = F.array(*(F.lit(s) for s in SYLLABLES[script]))
        syllables = F.transform(
            places, lambda p: F.element_at(listed, F.conv(F.substring(digest, p, F.lit(1)), 16, 10).cast("int") + 1)
        )
        ending = F.when(kind == "female", ENDINGS[script]["female"]).otherwise(ENDINGS[script]["male"])
        return F.initcap(F.concat(F.array_join(syllables, ""), ending))

    return F.when(form.rlike(r"\p{IsCyrillic}"), named("cyrillic")).otherwise(named("latin"))


def with_luhn(number: Column) -> Column:
    """A number whose last digit is made the check digit of those before it."""
    body = F.substring(number, F.lit(1), F.length(number) - 1)
    doubled = F.transform(
        F.split(F.reverse(body), ""),
        lambda d, i: F.when(i % 2 == 0, (d.cast("int") * 2).cast("int")).otherwise(d.cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda t, d: t + F.when(d > 9, d - 9).otherwise(d))
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def with_iban_check(iban: Column) -> Column:
    """An IBAN whose third and fourth characters are made its check digits."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00"))
    rest = F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda t, c: F.when(c.between("0", "9"), t * 10 + F.ascii(c) - 48).otherwise(t * 100 + F.ascii(c) - 55) % 97,
    )
    check = F.lpad((98 - rest).cast("string"), 2, "0")
    return F.concat(F.substring(iban, 1, 2), check, F.substring(iban, F.lit(5), F.length(iban)))


def candidate(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """The surrogate of a normal form that is tried at ``attempt``."""
    digest = _digest(key, kind, form, attempt.cast("string"))
    shaped = _shaped(form, digest)
    user, host = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    # The host's surrogate hangs on the host alone, so addresses of one host stay together.
    server = F.regexp_replace(host, r"\.[^.]*$", "")
    new_host = F.concat(_shaped(server, _digest(key, F.lit("host"), server)), F.lit("."), F.substring_index(host, ".", -1))
    longer = F.substring(F.translate(digest, "0123456789abcdef", "etaoinshrdlucmfw"), F.lit(40), F.greatest(attempt - 2, F.lit(0)))
    octets = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: (F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int") % 254 + 1).cast("string"),
    )
    hexed = F.transform(
        F.split(form, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(digest, F.pmod(i, F.lit(64)) + 1, F.lit(1)))
    )
    kept = F.substring(form, 1, 1)
    return (
        F.when(kind == "email", F.concat(_shaped(user, digest), longer, F.lit("@"), new_host))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "ip6", F.array_join(hexed, ""))
        .when(kind.isin(*GENDERS), _made_up_name(kind, form, digest, attempt))
        .when(kind == "phone", F.concat(kept, F.substring(shaped, F.lit(2), F.length(shaped))))
        .when(kind == "card", with_luhn(F.concat(kept, F.substring(shaped, F.lit(2), F.length(shaped)))))
        .when(kind == "secret", F.substring(digest, F.lit(1), F.length(form)))
        .when(kind == "iban", with_iban_check(F.concat(F.substring(form, 1, 2), F.substring(shaped, F.lit(3), F.length(shaped)))))
        .when(kind == "key", F.concat(F.substring(form, 1, 4), F.substring(shaped, F.lit(5), F.length(shaped))))
        .otherwise(shaped)
    )


def in_layout(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate written as the entity was, with its separators and spacing."""
    gaps = F.when(kind == "iban", F.split(entity, "[0-9A-Z]", -1)).otherwise(F.split(entity, "[0-9]", -1))
    written = F.when((kind == "phone") & entity.rlike(_WITH_ONE), F.concat(F.lit("1"), surrogate)).otherwise(surrogate)
    digits = F.zip_with(
        gaps, F.split(written, ""), lambda gap, d: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(d, F.lit("")))
    )
    return (
        F.when(kind.isin(*DIGIT_KINDS, "iban"), F.array_join(digits, ""))
        .otherwise(surrogate)
    )


def assign(forms: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for the distinct (kind, form): surrogates differ from each other
    and from every form of their kind; those of men also from names of women, and the other way round."""
    done = None
    left = stage(forms.select("kind", "form", F.lit(0).alias("attempt")), "forms")
    both = F.when(F.col("kind").isin(*GENDERS), F.array(*map(F.lit, GENDERS))).otherwise(F.array("kind"))
    known = left.select(F.explode(both).alias("kind"), F.col("form").alias("surrogate"))
    for _ in range(ROUNDS):
        tried = left.withColumn("surrogate", candidate(key, F.col("kind"), F.col("form"), F.col("attempt")))
        taken = known if done is None else known.unionByName(done.select("kind", "surrogate"))
        first = tried.groupBy("kind", "surrogate").agg(F.min("form").alias("first"))
        free = first.join(taken, ["kind", "surrogate"], "left_anti")
        judged = stage(tried.join(free, ["kind", "surrogate"], "left"), "surrogates")
        won = judged.filter(F.col("first").eqNullSafe(F.col("form"))).select("kind", "form", "surrogate")
        done = won if done is None else stage(done.unionByName(won), "assigned")
        left = judged.filter(~F.col("first").eqNullSafe(F.col("form"))).select(
            "kind", "form", (F.col("attempt") + 1).alias("attempt")
        )
        if left.isEmpty():
            return done
    raise RuntimeError(f"no distinct surrogates after {ROUNDS} rounds")


#: Not the beginning of a text or sentence.
_INSIDE = r"(?<!^)(?<!\n)(?<![.!?…]\s{1,3})(?<![.!?…][\"»”’)]\s{1,3})"


def _later_mentions(gap: Column, people: Column, nouns: Column, small: Column) -> Column:
    """``gap`` with the names that a title introduced in the same text replaced where they stand alone;
    of a man and a woman of one name the first in order counts."""

    def person(text, p):
        word = p["word"]
        place = F.when(F.array_contains(small, F.lower(word)), _INSIDE).otherwise("")
        pattern = F.concat(place, F.lit(r"(?<![\p{L}\p{N}])"), word, F.lit(r"(?![\p{L}\p{N}])"))
        barred = word.rlike(f"^(?:{_NO_NAME}|{_DAY})$") | F.array_contains(nouns, word)
        return F.when(barred, text).otherwise(F.regexp_replace(text, pattern, p["new"]))

    return F.aggregate(people, gap, person)


def with_surrogates(docs: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``docs`` with its entities replaced in text, and a column with their number; its name."""
    count = fresh(docs, "n_entities")
    found, row_key, words, nouns, small = (
        fresh(docs, n) for n in ("_entities", "_text_key", "_names", "_nouns", "_small")
    )
    firsts, seconds, people = (fresh(docs, n) for n in ("_firsts", "_seconds", "_people"))
    columns = [f"`{c}`" for c in docs.columns]
    entities = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    maybe = may_hold(F.col("text"))
    holding = docs.filter(maybe).withColumn(found, entities).filter(F.size(found) > 0).withColumn(row_key, F.sha2("text", 256))
    # The words of names that the text also has as nouns, and those that it has in small letters.
    named = F.flatten(F.transform(F.filter(F.array_distinct(found), is_person), name_words))
    no_words = F.array().cast("array<string>")

    def also(pattern, group, names):
        seen = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
        return F.when(F.size(words) > 0, F.array_intersect(seen, names)).otherwise(no_words)

    touched = stage(
        holding.withColumn(words, named)
        .withColumn(nouns, also(_NOUN, 1, F.col(words)))
        .withColumn(small, also(r"(?<!\p{L})\p{Ll}[\p{L}'’-]+", 0, F.transform(words, F.lower)))
        .drop(words),
        "entities",
    )
    occurring = (
        touched.select(row_key, F.col(nouns).alias("nouns"), F.explode(F.array_distinct(found)).alias("entity"))
        .withColumn("kind", kind_of(F.col("entity")))
        .select(row_key, "entity", F.explode(parts(F.col("kind"), F.col("entity"), F.col("nouns"))).alias("part"))
        .select(row_key, "entity", "part.*")
        .distinct()
    )
    assigned = assign(occurring.select("kind", "form").distinct(), key)
    # Per text the replacements of its distinct entities; a text's entities are as bounded as the text.
    replaced = (
        occurring.join(assigned, ["kind", "form"])
        .withColumn("new", in_layout(F.col("kind"), F.col("entity"), F.col("surrogate")))
        .groupBy(row_key)
        .agg(
            F.map_from_entries(F.collect_list(F.when(F.col("place") == 0, F.struct("entity", "new")))).alias(firsts),
            F.map_from_entries(F.collect_list(F.when(F.col("place") == 1, F.struct("entity", "new")))).alias(seconds),
            F.array_sort(
                F.collect_set(F.when(F.col("kind").isin(*GENDERS), F.struct(F.col("form").alias("word"), "new")))
            ).alias(people),
        )
    )
    gaps = F.transform(
        F.split("text", PATTERN, -1), lambda gap: _later_mentions(gap, F.col(people), F.col(nouns), F.col(small))
    )

    def written(entity):
        first = F.try_element_at(F.col(firsts), entity)
        second = F.coalesce(F.try_element_at(F.col(seconds), entity), F.get(name_words(entity), F.lit(1)))
        name = F.concat(F.regexp_extract(entity, _LEAD, 0), first, F.coalesce(F.concat(F.lit(" "), second), F.lit("")))
        return F.when(is_person(entity), name).otherwise(first)

    new = F.transform(F.col(found), written)
    rebuilt = F.array_join(
        F.zip_with(gaps, new, lambda gap, n: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(n, F.lit("")))), ""
    )
    changed = touched.join(replaced, row_key).withColumn("text", rebuilt).withColumn(count, F.size(found).cast("long"))
    clean = docs.filter(~(maybe & F.coalesce(F.col("text").rlike(PATTERN), F.lit(False)))).withColumn(count, F.lit(0).cast("long"))
    return clean.select(*columns, count).unionByName(changed.select(*columns, count)), count


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in its texts."""
    result, count = with_surrogates(docs, key)
    return result.drop(count)
