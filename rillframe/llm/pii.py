"""Surrogates for personal data, with DataFrame expressions only.

Entities (addresses of mail and internet, telephone, card, account and social security numbers, access keys and other secrets, names of persons)
are found by one pattern. Each distinct entity gets a keyed seed, and its surrogate is drawn from that seed character by character: a digit gives
way to a digit, a Latin or Cyrillic vowel or consonant to one of its kind and case, and punctuation and spacing stay. A given name
gives way to one of the same gender and script, a valid card number to a valid one, and an internet address to an address. The same entity has the
same surrogate everywhere, whatever its spacing or case; a person's surname decides, so that "Mr Smith" and "John Smith" stay related. A name goes on
over all capitalised words that follow it, and the last one counts as the surname; the words between are drawn anew as well.

Different entities keep different surrogates, and none equals an entity of the corpus: clashes of surrogates are found by joins over the
distinct entities, and the later one by name draws again until there are none.

A surrogate keeps the length and form of its entity as long as that form has a free member; then it grows.

Null and empty texts stay as they are, texts without entities unchanged; an empty table gives an empty one. Repeated rows stay repeated. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import row_key, written

# Common given names by gender and script, honorifics by gender, and titles without one.
GIVEN = {
    ("f", "latin"): "Mary Anna Emma Laura Sarah Julia Linda Susan Karen Alice Clara Elena Marie Sophie Maria Lucia Carmen Isabel Ingrid Heike Camille Claire Helen Ruth".split(),
    ("m", "latin"): "John James Robert Michael David Thomas Peter Paul Mark George Hans Klaus Stefan Jean Pierre Louis Carlos Juan Miguel Antonio Henry Frank Daniel Martin".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Дмитрий Сергей Андрей Алексей Николай Владимир Михаил".split(),
}
HONORIFICS = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Mlle Señor Señora Sr Sra Don Doña Г-н Г-жа".split()
# Patterns of entities, tried in this order at the start of each word or number.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_HONORIFIC = rf"(?:{'|'.join(HONORIFICS)})(?!\p{{L}})\.?"
_CAPITAL_HONORIFIC = r"(?:MR|MRS|MS|DR|PROF|HERR|FRAU)(?!\p{L})\.?"
_PARTICLE = "(?:van|von|zu|der|den|ten|ter|de|del|della|di|da|dos|du|la|le|el|al|bin|ibn)"
# a capitalised word whole: inner capitals, apostrophes (but for a possessive s) and hyphens belong to it
_WORD = r"\p{Lu}(?:[\p{L}\p{M}]++|(?=['’]\p{L}))(?:['’](?![sS](?!\p{L}))[\p{L}\p{M}]++|[-‐‑][\p{L}\p{M}]++)*+"
_NAME = rf"(?:{_PARTICLE}[ ])*+(?:d['’])?+(?:\p{{Lu}}\.[ ]?)*+{_WORD}"
# a name in capitals all through takes in two more words at most, as whole headings stand so
_CAPITALS = r"\p{Lu}{2,}(?:['’-]\p{Lu}{2,})*+(?![\p{L}\p{N}])"
PATTERNS = {
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?:\d{4}[ -]?){3}\d{4}(?![\w-])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])",
    "secret": r"(?:[A-Za-z0-9]++[_.-]){0,8}(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)(?:\d++|(?:_[A-Za-z0-9]++)++)?+[ \t]*+[=:][ \t]*+[\"']?(?=[_+/-]*+[A-Za-z0-9])[A-Za-z0-9_+/-]{8,}",
    "key": r"(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "person": rf"(?=\p{{Lu}})(?:(?:(?:{_HONORIFIC}[ ])++|(?:{_GIVEN})(?:-{_WORD})?+[ ]){_NAME}(?:[ ]{_NAME})*+|(?:{_CAPITAL_HONORIFIC}|(?:{_GIVEN.upper()})(?:-{_CAPITALS})?+)(?:[ ]{_CAPITALS}){{1,2}})",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,255}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
}
_FIGURES = "|".join(PATTERNS[k] for k in ("ip", "card", "ssn", "phone"))
_LETTERS = "|".join(PATTERNS[k] for k in ("secret", "key", "iban", "person", "email"))
ENTITY = rf"(?<![A-Za-z0-9_À-ӿ])(?:(?=[0-9+(])(?:{_FIGURES})|{_LETTERS})"
# Characters that may stand for each other.
KINDS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "аеиоу", "бвгджзклмнпрст", "АЕИОУ", "БВГДЖЗКЛМНПРСТ")
MEMBERS = ("0123456789", "aeiouàáâäèéêëìíîïòóôöùúûü", "bcdfghjklmnpqrstvwxyzçñß", "AEIOUÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "BCDFGHJKLMNPQRSTVWXYZÇÑ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ")
#: After so many draws a surrogate may also grow, by one character a draw: a short entity may have no other form left, and so every entity gets one in the end.
GROWS_AFTER = 3


def kind_of(value: Column) -> Column:
    """Type of a found entity."""
    out = F.lit("person")
    for name in reversed([k for k in PATTERNS if k != "person"]):
        out = F.when(value.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(out)
    return out


def _luhn_sum(digits: Column) -> Column:
    """Sum of the digits of a card number, with every second one from the right doubled."""
    part = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0), lambda a, x: a + x)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check of card numbers."""
    return _luhn_sum(digits) % 10 == 0


def _secret(value: Column) -> Column:
    """What a secret's name introduces."""
    return F.regexp_extract(value, "[A-Za-z0-9_+/-]+$", 0)


def same_entity(kind: Column, value: Column) -> Column:
    """What all spellings of an entity have in common."""
    plain = F.regexp_replace(value, r"[^0-9A-Za-z]", "")
    return F.when(kind == "email", F.lower(value)).when(kind == "person", F.translate(F.lower(F.substring_index(value, " ", -1)), "’‐‑", "'--")).when(kind.isin("phone", "card", "ssn", "iban"), plain).when(kind == "secret", _secret(value)).otherwise(value)


def _byte(seed: Column, i: Column) -> Column:
    """A byte of the stream that a seed of 128 hex digits gives; another hash begins after each 64."""
    block = F.when(i < 64, seed).otherwise(F.sha2(F.concat(seed, F.floor(i / 64).cast("string")), 512))
    return F.conv(F.substr(block, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _characters(value: Column, seed: Column, hexes: Column) -> Column:
    """value with each letter and digit drawn anew; what stands at the same place among letters and digits gets the same draw."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")

    kinds = F.create_map(*[F.lit(x) for k, members in enumerate(MEMBERS) for c in members for x in (c, k)])

    def drawn(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(value, F.lit(1), i.cast("int")), r"[^\p{L}\p{N}]", ""))
        # letters of other scripts give way to Latin consonants
        kind = F.coalesce(F.element_at(kinds, c), F.when(c.rlike(r"^\p{Lu}$"), 4).when(c.rlike(r"^\p{L}$"), 2))
        alphabet = F.when(hexes & kind.isin(1, 2), "abcdef").when(hexes & kind.isin(3, 4), "ABCDEF").otherwise(F.element_at(F.array(*map(F.lit, KINDS)), kind + 1))
        return F.coalesce(F.substr(alphabet, (_byte(seed, before) % F.length(alphabet) + 1).cast("int"), F.lit(1)), c)

    return F.array_join(F.transform(chars, drawn), "")


def _given(name: Column, key: str) -> Column:
    """Another given name of the same gender and script: the names in an order that the key decides, moved on by one."""
    out = name
    for names in GIVEN.values():
        order = F.array_sort(F.transform(F.array(*map(F.lit, names)), lambda n: F.struct(F.sha2(F.concat(F.lit(key), n), 256).alias("h"), n.alias("n"))))
        moved = F.map_from_arrays(F.transform(order, lambda s: s["n"]), F.transform(F.concat(F.slice(order, 2, len(names) - 1), F.slice(order, 1, 1)), lambda s: s["n"]))
        out = F.coalesce(F.element_at(moved, name), out)
    return out


def _before_surname(word: Column, seed: Column, key: str) -> Column:
    """A word of a name but the last: titles and particles stay, known given names are moved on, others drawn anew and never the same."""
    given = F.coalesce(F.when(word == F.upper(word), F.upper(_given(F.initcap(word), key))), _given(word, key))
    drawn = _characters(word, F.sha2(F.concat(seed, F.lower(word)), 512), F.lit(False))
    moved = F.translate(word, "".join(KINDS), "".join(k[1:] + k[:1] for k in KINDS))
    return F.when(word.rlike(f"^(?:{_HONORIFIC}|{_CAPITAL_HONORIFIC}|{_PARTICLE})$"), word).when(given != word, given).when(drawn != word, drawn).otherwise(moved)


def surrogate(kind: Column, value: Column, seed: Column, grows: Column, key: str) -> Column:
    """The surrogate of an entity as it is written in a text."""
    none = F.lit(False)
    words = F.split(value, " ")
    more = lambda members: F.when(grows > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(grows, F.lit(1))), lambda i: F.substr(F.lit(members), (_byte(seed, i + 40) % len(members) + 1).cast("int"), F.lit(1))), "")).otherwise("")
    # what a type keeps of the start and the end
    head = (
        F.when(kind == "secret", F.length(value) - F.length(_secret(value)))
        .when(kind.isin("key", "iban"), 4)
        .when(kind == "card", 1)
        .when(kind == "phone", F.length(F.regexp_extract(value, r"^(?:\+\d{1,3}(?=\D)|\+\d)", 0)))
        .when(kind == "person", F.length(value) - F.length(F.element_at(words, -1)))
        .otherwise(0)
    )
    tail = F.when(kind == "email", F.length(F.substring_index(value, ".", -1)) + 1).otherwise(0)
    body = F.substr(value, head + 1, F.length(value) - head - tail)
    drawn = _characters(body, seed, F.when(kind == "secret", body.rlike("^[0-9A-Fa-f]+$")).otherwise(none))
    out = F.concat(F.substr(value, F.lit(1), head), drawn, F.substr(value, F.length(value) - tail + 1, tail))
    digits = F.regexp_replace(F.concat(F.substr(value, F.lit(1), head), drawn), "[^0-9]", "")
    last = (10 - _luhn_sum(F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))) % 10) % 10
    valid = luhn(F.regexp_replace(value, "[^0-9]", ""))
    names = F.array_join(F.transform(F.slice(words, 1, F.size(words) - 1), lambda w: _before_surname(w, seed, key)), " ")
    return (
        F.when(kind == "ip", F.concat(F.concat_ws(".", *[(_byte(seed, F.lit(i)) % 254 + 1).cast("string") for i in range(4)]), F.when(grows > 0, ".").otherwise(""), more("123456789")))
        .when((kind == "card") & valid & (grows == 0), F.concat(F.substr(out, F.lit(1), F.length(out) - 1), last.cast("string")))
        .when(kind == "person", F.concat(names, F.when(F.size(words) > 1, " ").otherwise(""), drawn, F.when(value == F.upper(value), more("AEIOU")).otherwise(more("aeiou"))))
        .when(kind == "email", F.concat(more("bcdfghklmnprst"), out))
        .otherwise(F.concat(out, more("0123456789")))
    )


def found(text: Column) -> Column:
    """Entities of a text in order, as they are written."""
    return F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))


def seeds(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, entity, value: one way to write it), distinct by the first two, with seed and grows such that surrogates differ."""
    named = entities.withColumn("plain", F.when(F.col("kind") == "person", F.initcap("entity")).when(F.col("kind").isin("email", "phone"), F.col("value")).otherwise(F.col("entity")))
    same = lambda c: same_entity(F.col("kind"), F.col(c))
    real = written(named, "pii-entities")
    done: DataFrame | None = None
    pending, attempt = real, 0
    while True:
        drawn = pending.withColumn("seed", F.sha2(F.concat_ws("\x1f", F.lit(key), "kind", "entity", F.lit(str(attempt))), 512)).withColumn("grows", F.lit(max(0, attempt - GROWS_AFTER)))
        drawn = written(drawn.withColumn("drawn", surrogate(F.col("kind"), F.col("plain"), F.col("seed"), F.col("grows"), key)).withColumn("drawn", same("drawn")), "pii-draws")
        first = drawn.groupBy("kind", "drawn").agg(F.min("entity").alias("entity"))
        good = drawn.join(first, ["kind", "drawn", "entity"], "left_semi").join(real.select("kind", F.col("entity").alias("drawn")), ["kind", "drawn"], "left_anti")
        if done is not None:
            good = good.join(done.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        good = written(good.select("kind", "entity", "seed", "grows", "drawn"), "pii-good")
        done = good if done is None else done.unionByName(good)
        pending = written(drawn.join(good, ["kind", "entity"], "left_anti").select("kind", "entity", "value", "plain"), "pii-pending")
        attempt += 1
        if pending.isEmpty():
            return done.select("kind", "entity", "seed", "grows")


def replace(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text and a column n_entities (one of that name is replaced).

    Each text moves at most once, to meet its own entities' seeds; an entity that a third of the texts holds meets its seed in a join that Spark
    can split. Texts without entities are matched against the pattern once, the others again when their entities give way.
    """
    docs = docs.drop("n_entities")
    plain = [F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(*plain).alias("_row"))
    text = F.col("doc")[text_col]
    one = rows.select("_row", F.explode(F.array_distinct(found(text))).alias("value")).withColumn("kind", kind_of(F.col("value")))
    one = one.withColumn("entity", same_entity(F.col("kind"), F.col("value")))
    one = written(one.distinct(), "pii-found")
    known = seeds(one.groupBy("kind", "entity").agg(F.min("value").alias("value")), key)
    drawn = one.join(known, ["kind", "entity"]).withColumn("new", surrogate(F.col("kind"), F.col("value"), F.col("seed"), F.col("grows"), key))
    own = drawn.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("value", "new"))).alias("_new"))
    joined = rows.join(own, "_row", "left")
    news = F.transform(found(text), lambda v: F.coalesce(F.element_at("_new", v), v))
    changed = F.array_join(F.flatten(F.zip_with(F.split(text, ENTITY, -1), F.concat(news, F.array(F.lit(""))), lambda p, s: F.array(p, s))), "")
    n = F.when(F.col("_new").isNull(), 0).otherwise(F.size(found(text)))
    columns = {c: F.col("doc")[c] for c in docs.columns} | {text_col: F.when(F.col("_new").isNull(), text).otherwise(changed)}
    return joined.select(*[v.alias(c) for c, v in columns.items()], n.cast("long").alias("n_entities"))
