"""Personal data replaced by keyed surrogates, in DataFrame expressions alone."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import table
from quadloom.sources.staging import staged

#: The secret of the registered queries; a user gives their own.
QUERY_KEY = "surrogates"
MAX_ROUNDS = 40
#: Attempts after which a private address may leave its block.
CROWDED = 8

MEN = "Mr|Herr|Monsieur|Señor|Sr|господин"
WOMEN = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
LABEL = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)"
ASSIGNED = LABEL + r"[ ]{0,3}[=:][ ]{0,3}[\"']?"
BLOCK = "(?:[A-Z0-9]{1,12} ){0,3}PRIVATE KEY-----"
LOCAL = r"(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}"
HEX = "[0-9A-Fa-f]{1,4}"
#: What is found where no ASCII letter or digit stands before, in order of precedence where two start at the same
#: place. Only single characters are repeated without a bound: Java takes those in a loop, but groups by recursion,
#: and long texts would end its stack.
PATTERNS = {
    "key_block": rf"-----BEGIN {BLOCK}[A-Za-z0-9+/=\s]+-----END {BLOCK}",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-][\p{L}\p{N}.-]*\.\p{L}{2,}",
    "secret": ASSIGNED + r"[A-Za-z0-9+/_.~-]{8,}",
    "access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ip": rf"(?<!\.){OCTET}\.{OCTET}\.{OCTET}\.{OCTET}(?!\.?[A-Za-z0-9])",
    "ipv6": rf"(?<!:)(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![A-Za-z0-9:])",
    "phone": rf"(?:(?:\+\d{{1,3}}[ .-]?)?{LOCAL}|\+\d(?:[ ().-]{{0,2}}\d){{7,14}}|0\d(?:[ .-]\d\d){{4}}|0\d{{2,4}}[ /]\d{{5,8}}|0\d{{2,4}} \d{{3,4}} \d{{3,4}})(?![A-Za-z0-9])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![A-Za-z0-9])",
    "card": r"\d(?:[ -]?\d){12,18}(?![A-Za-z0-9])",
    "person": rf"(?<!\p{{L}})(?:{MEN}|{WOMEN})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}",
}
ANY = f"(?<![A-Za-z0-9])(?:{'|'.join(PATTERNS.values())})"

LATIN = "ba de fi go lu ma ne ri so tu va we".split()
CYRILLIC = "ба де фи го лу ма не ри со ту ва же".split()
#: Letters that stand for letters outside ASCII, by script and case.
LETTERS = {r"[à-öø-ÿ]": "àáâäåæçèéêëìíîïñòóôöøùúûü", r"[À-ÖØ-Þ]": "ÀÁÂÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜ", "[а-яё]": "абвгдежзиклмнопрстуфхцчшэюя", "[А-ЯЁ]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", r"\p{IsHan}": "文安平明海山川林田中大小東西南北春夏秋冬", r"\p{L}": "αβγδεζηθικλμνξοπρστυφχψω"}


def kind_of(found: Column) -> Column:
    """The kind of a string that ANY has found."""
    whole = [(k, F.regexp_like(found, F.lit(f"^(?:{p})$"))) for k, p in PATTERNS.items()]
    return reduce(lambda rest, x: F.when(x[1], x[0]).otherwise(rest), reversed(whole), F.lit(None).cast("string"))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once; a plain expression would be worked out at each place it stands, and anew
    for each element within a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hmac(key: str, message: Column) -> Column:
    """Hex of the keyed hash HMAC-SHA-256."""
    secret = key.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in secret)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _stream(key: str, kind: str | Column, name: Column, attempt: Column, n: Column) -> Column:
    """Blocks of hex digits from the key and what is named, two digits for each of n places."""
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / 32).cast("int"))
    part = lambda i: _hmac(key, F.concat_ws("|", F.lit(kind) if isinstance(kind, str) else kind, name, attempt.cast("string"), i.cast("string")))
    return F.transform(blocks, part)


def _byte(stream: Column, i: Column) -> Column:
    block = F.element_at(stream, F.floor(i / 32).cast("int") + 1)
    return F.conv(F.substr(block, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters_and_digits(text: Column, stream: Column, low: Column) -> Column:
    """Each letter or digit becomes another of its script and case, small ASCII letters one of the first `low`; all else, and so the format, stays."""

    def other(c: Column, i: Column) -> Column:
        def swapped(b: Column) -> Column:
            code = F.ascii(c)
            out = F.when(code.between(48, 57), F.char(b % 10 + 48)).when(code.between(97, 122), F.char(b % low + 97)).when(code.between(65, 90), F.char(b % low + 65)).when(code < 128, c)
            for letters, some in LETTERS.items():
                out = out.when(F.regexp_like(c, F.lit(letters)), F.substr(F.lit(some), b % len(some) + 1, F.lit(1)))
            return out.otherwise(c)

        return let(_byte(stream, i), swapped)

    return F.array_join(F.transform(F.split(text, ""), other), "")


def _parts(found: Column, kind: str) -> tuple[Column, Column]:
    """What of an entity stays in front, and the rest."""
    national = F.regexp_like(found, F.lit(rf"^(?:\+1[ .-]?)?{LOCAL}$"))
    kept = {
        "key_block": lambda: F.regexp_extract(found, f"^-----BEGIN {BLOCK}", 0),
        "secret": lambda: F.regexp_extract(found, f"^{ASSIGNED}", 0),
        "access_key": lambda: F.substr(found, F.lit(1), F.lit(4)),
        # the country's code, cut at two digits unless it is 1 or 7, or a leading 0
        "phone": lambda: F.when(national, F.regexp_extract(found, r"^(?:\+1[ .-]?)?", 0)).otherwise(F.regexp_extract(found, r"^(?:\+(?:[17]|\d\d)|0)?", 0)),
    }[kind]()
    return kept, F.substr(found, F.length(kept) + 1, F.length(found))


def _kept(found: Column, kind: Column) -> tuple[Column, Column]:
    """The front and the end of an entity that stay: labels, country codes, the first digit of a card, the ending of a domain."""
    front = reduce(lambda rest, k: F.when(kind == k, _parts(found, k)[0]).otherwise(rest), ["key_block", "secret", "access_key", "phone"], F.lit(""))
    end = F.when(kind == "key_block", F.regexp_extract(found, f"-----END {BLOCK}$", 0)).when(kind == "email", F.regexp_extract(found, r"\.\p{L}+$", 0)).otherwise("")
    return front, end


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


#: What tells entities of a kind apart: digits alone of numbers, small letters of addresses and names, a person's
#: gender without the title, the value alone of a secret; else the string itself.
SAME = {
    "email": F.lower,
    "ipv6": F.lower,
    "person": lambda x: F.concat(F.when(F.regexp_like(x, F.lit(rf"^(?:{WOMEN})\.? ")), "f ").otherwise("m "), F.lower(F.regexp_replace(x, r"^\S+ ", ""))),
    "ssn": _digits,
    "card": _digits,
    "phone": lambda x: _digits(_parts(x, "phone")[1]),
    "secret": lambda x: _parts(x, "secret")[1],
    "key_block": lambda x: F.regexp_replace(_parts(x, "key_block")[1], r"\s", ""),
}


def canonical(found: Column, kind: Column) -> Column:
    """The name that an entity's strings share; see SAME. found should be a plain column, as it is used for each kind."""
    return reduce(lambda rest, x: F.when(kind == x[0], x[1](found)).otherwise(rest), SAME.items(), found)


def _other_digits(digits: Column, stream: Column) -> Column:
    return F.array_join(F.transform(F.split(digits, ""), lambda _, i: (_byte(stream, i) % 10).cast("string")), "")


def _refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced in order by those given."""

    def put(fresh: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            nth = F.length(_digits(F.substr(form, F.lit(1), i + 1)))
            return F.when(c.between("0", "9"), F.substr(fresh, nth, F.lit(1))).otherwise(c)

        return F.array_join(F.transform(F.split(form, ""), one), "")

    return let(digits, put)


def _ip(found: Column, stream: Column, attempt: Column) -> Column:
    private = F.regexp_extract(found, r"^(?:10\.|192\.168\.)", 0)
    fresh = F.concat_ws(".", *[(_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    # a full block is left: 192.168/16 for 10/8, and both at last for all addresses
    private = F.when(attempt >= 2 * CROWDED, "").when(attempt >= CROWDED, F.when(F.length(private) > 0, "10.").otherwise("")).otherwise(private)
    return F.concat(private, F.when(F.length(private) == 3, F.regexp_replace(fresh, r"^\d+\.", "")).when(F.length(private) > 3, F.regexp_replace(fresh, r"^\d+\.\d+\.", "")).otherwise(fresh))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = F.split(F.reverse(digits), "")
    value = F.transform(each, lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(F.ascii(c) > 52, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10


def _card(digits: Column, stream: Column) -> Column:
    """The first digit stays; a number with a right check digit gets one with a right check digit."""
    fresh = F.concat(F.substr(digits, F.lit(1), F.lit(1)), _other_digits(F.substr(digits, F.lit(2), F.length(digits)), stream))
    front = F.substr(fresh, F.lit(1), F.length(fresh) - 1)
    right = F.concat(front, ((10 - _luhn(F.concat(front, F.lit("0")))) % 10).cast("string"))
    return F.when(_luhn(digits) == 0, right).otherwise(fresh)


def _spelled_name(role: Column, word: Column, key: str, attempt: Column) -> Column:
    """A name for a word as surname (role s), a woman's (f) or a man's (m) first name; each attempt has one more syllable than the last."""

    def spelled(stream: Column) -> Column:
        cyrillic = F.regexp_like(word, F.lit(r"\p{IsCyrillic}"))
        parts = F.when(cyrillic, F.array(*map(F.lit, CYRILLIC))).otherwise(F.array(*map(F.lit, LATIN)))
        syllable = lambda k: F.element_at(parts, _byte(stream, k) % len(LATIN) + 1)
        ending = F.when(role == "s", F.when(cyrillic, "ко").otherwise("ck")).when(role == "f", F.when(cyrillic, "на").otherwise("na")).otherwise(F.when(cyrillic, "н").otherwise("n"))
        return F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 3), syllable), ""), ending))

    return let(_stream(key, "person", F.concat(role, word), attempt, attempt + 6), spelled)


def _person(found: Column, key: str, attempt: Column, family: Column) -> Column:
    """The title stays; names are of the title's gender and the name's script, and in capitals where the name is.

    Each name word has its own surrogate, so a person's short and full forms agree; attempts change first names.
    family: the attempt of the surname, the same in all forms.
    """
    words = F.split(found, " ")
    n = F.size(words)
    woman = F.regexp_like(found, F.lit(rf"^(?:{WOMEN})\.? "))

    def name(word: Column, i: Column) -> Column:
        role = F.when(i == n - 1, "s").when(woman, "f").otherwise("m")
        made = _spelled_name(role, F.lower(word), key, F.when(i == n - 1, family).otherwise(attempt))
        return F.when(i == 0, word).when(word == F.upper(word), F.upper(made)).otherwise(made)

    return F.array_join(F.transform(words, name), " ")


def surrogate(found: Column, key: str, attempt: Column | int = 0, family: Column | int = 0, kind: Column | None = None) -> Column:
    """A replacement of the same kind and format, that depends on the key, the entity and the attempts alone."""
    family = F.lit(family) if isinstance(family, int) else family
    attempt = F.lit(attempt) if isinstance(attempt, int) else attempt
    kind = kind_of(found) if kind is None else kind
    front, end = _kept(found, kind)

    def made(x: Column) -> Column:
        body = F.substr(found, F.length(x["front"]) + 1, F.length(found) - F.length(x["front"]) - F.length(x["end"]))

        def other(stream: Column) -> Column:
            hexadecimal = (kind == "ipv6") | ((kind == "secret") & F.regexp_like(body, F.lit("^[0-9a-f]+$")))
            numbers = F.when(kind == "card", _card(x["name"], stream)).otherwise(_other_digits(x["name"], stream))
            out = F.when(kind.isin("phone", "ssn", "card"), _refilled(body, numbers)).when(kind == "ip", _ip(found, stream, attempt))
            return F.concat(x["front"], out.otherwise(let(F.when(hexadecimal, 6).otherwise(26), lambda low: _letters_and_digits(body, stream, low))), x["end"])

        return let(_stream(key, kind, x["name"], attempt, F.length(body) + 4), other)

    rest = let(F.struct(front.alias("front"), end.alias("end"), canonical(found, kind).alias("name")), made)
    return F.when(kind == "person", _person(found, key, attempt, family)).otherwise(rest)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, entity, found) of the distinct entities, with one of the strings that name it; partial sums before the shuffle keep an entity in every text from piling up."""
    text = F.col(f"`{text_col}`")
    found = docs.select(F.explode(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("found")).distinct()
    kinds = found.withColumn("kind", kind_of(F.col("found")))
    return kinds.withColumn("entity", canonical(F.col("found"), F.col("kind"))).groupBy("kind", "entity").agg(F.min("found").alias("found"))


def _surname(entity: Column) -> Column:
    return F.element_at(F.split(entity, " "), -1)


def surnames(people: DataFrame, key: str) -> DataFrame:
    """(word, family) of the surnames whose surrogate is not that of their first attempt: another's, or a real surname."""
    now = staged(people.select(_surname(F.col("entity")).alias("word")).distinct()).withColumn("family", F.lit(0))
    taken = now.select(F.col("word").alias("s"), F.lit(True).alias("real"))
    for _ in range(MAX_ROUNDS):
        made = now.withColumn("s", F.lower(_spelled_name(F.lit("s"), F.col("word"), key, F.col("family"))))
        first = F.min(F.struct("family", "word")).over(Window.partitionBy("s"))
        ranked = made.withColumn("late", F.col("word") != first["word"]).join(taken, "s", "left")
        made = staged(ranked.select("word", "family", (F.col("late") | F.col("real").isNotNull()).alias("clash")))
        if made.where("clash").isEmpty():
            return made.where("family > 0").select("word", "family")
        now = made.select("word", (F.col("family") + F.col("clash").cast("int")).alias("family"))
    raise RuntimeError("surnames still collide")


def collisions(found: DataFrame, key: str) -> DataFrame:
    """(kind, entity, attempt, family) of the entities whose first surrogate would be another's, or a real entity.

    found: (kind, entity, found). Each round gives those that collide the next attempt, all but the first of each
    surrogate, ties to the smallest entity; ends when all are distinct. Surnames are told apart first, word by word,
    so that short and full forms of a name keep one surname; then first names are.
    """
    real = staged(found)
    families = surnames(real.where("kind = 'person'"), key)
    last = F.when(F.col("kind") == "person", _surname(F.col("entity")))
    now = real.withColumn("word", last).join(families, "word", "left").select("kind", "entity", "found", F.lit(0).alias("attempt"), F.coalesce("family", F.lit(0)).alias("family"))
    taken = real.select("kind", F.col("entity").alias("s"), F.lit(True).alias("real"))
    for _ in range(MAX_ROUNDS):
        made = now.withColumn("made", surrogate(F.col("found"), key, F.col("attempt"), F.col("family"), F.col("kind"))).withColumn("s", canonical(F.col("made"), F.col("kind")))
        first = F.min(F.struct("attempt", "entity")).over(Window.partitionBy("kind", "s"))
        ranked = made.withColumn("late", F.col("entity") != first["entity"]).join(taken, ["kind", "s"], "left")
        made = staged(ranked.select("kind", "entity", "found", "attempt", "family", (F.col("late") | F.col("real").isNotNull()).alias("clash")))
        if made.where("clash").isEmpty():
            return made.where("attempt > 0 or family > 0").select("kind", "entity", "attempt", "family")
        now = made.select("kind", "entity", "found", "family", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise RuntimeError("surrogates still collide; the formats hold too few values")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count: str | None = None) -> DataFrame:
    """docs with every entity in text_col replaced by its surrogate; all else stays, and count, if named, tells how many.

    Equal entities get equal surrogates in all texts and formats, different ones different surrogates, and none is a
    real entity of the table. key: the secret; without it nobody can tell what a surrogate stands for. Null texts stay
    null (count 0); repeated rows, null ids and other columns, whatever their names, pass through; an empty table
    stays empty; texts of any length are searched whole. Texts are never shuffled unless surrogates collide, and then by a
    hash of the text together with the few entities concerned, those without any by a hash of the row; copies of one text in very many rows are then split by
    Spark's skew join.
    """
    if not key:
        raise ValueError("a key is needed")
    text, names = F.col(f"`{text_col}`"), docs.columns
    fixes = collisions(entities(docs, text_col), key)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), text.alias("_text"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("_found"))
    one = lambda x: F.struct(x.alias("found"), kind_of(x).alias("kind"))
    if fixes.isEmpty():
        put = lambda x: surrogate(x["found"], key, kind=x["kind"])
    else:
        texts = kept.where(F.size("_found") > 0).select(F.xxhash64("_text").alias("_h"), F.explode(F.array_distinct("_found")).alias("found")).distinct()
        texts = texts.withColumn("kind", kind_of(F.col("found"))).withColumn("entity", canonical(F.col("found"), F.col("kind"))).join(fixes, ["kind", "entity"])
        new = texts.select("_h", F.struct("found", surrogate(F.col("found"), key, F.col("attempt"), F.col("family"), F.col("kind"))))
        maps = new.toDF("_h", "_pair").groupBy("_h").agg(F.map_from_entries(F.collect_set("_pair")).alias("_fix"))
        # texts without an entity need no map; a hash of their rows spreads them
        spread = F.xxhash64("_text", *(F.col("_row")[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
        kept = kept.withColumn("_h", F.when(F.size("_found") > 0, F.xxhash64("_text")).otherwise(spread)).join(maps, "_h", "left")
        put = lambda x: F.coalesce(F.try_element_at(F.col("_fix"), x["found"]), surrogate(x["found"], key, kind=x["kind"]))
    between = F.zip_with(F.split("_text", ANY, -1), F.concat(F.transform(F.transform("_found", one), put), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    new_text = F.when(F.size("_found") > 0, F.array_join(between, "")).otherwise(F.col("_text"))
    n = [F.greatest(F.coalesce(F.size("_found"), F.lit(0)), F.lit(0)).cast("long").alias(count)] if count else []
    return kept.select(*[new_text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names], *n)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY, count="n_entities")
