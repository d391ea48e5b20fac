"""Column functions over utterances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Verbs that take n't, irregular ones with what they stand for, pronouns with their verbs, and question words with is.
NEGATED = "are could did do does had has have is must need should was were would".split()
IRREGULAR = {"can't": "can not", "cannot": "can not", "won't": "will not", "shan't": "shall not", "ain't": "is not", "let's": "let us", "y'all": "you all", "gonna": "going to", "wanna": "want to", "gotta": "got to"}
PRONOUNS = {"i": ["'m am", "'ve have", "'ll will", "'d would"], "you": ["'re are", "'ve have", "'ll will", "'d would"], "we": ["'re are", "'ve have", "'ll will", "'d would"], "they": ["'re are", "'ve have", "'ll will", "'d would"], "he": ["'s is", "'ll will", "'d would"], "she": ["'s is", "'ll will", "'d would"], "it": ["'s is", "'ll will", "'d would"]}
MODALS = "could might must should would".split()
ASKED = "what where who how that there here when why".split()
#: Forms that are other words without their apostrophe, and so are left alone there.
AMBIGUOUS = {"we're", "we'll", "we'd", "i'll", "i'd", "he'll", "he'd", "she'll", "she'd", "it's", "shan't", "let's"}


def contractions() -> dict[str, str]:
    """Contractions and what they stand for, with and without the apostrophe where that is no other word."""
    out = {f"{v}n't": f"{v} not" for v in NEGATED} | IRREGULAR | {f"{w}'s": f"{w} is" for w in ASKED}
    out |= {p + x.split()[0]: f"{p} {x.split()[1]}" for p, xs in PRONOUNS.items() for x in xs}
    out |= {f"{w}'{x}": f"{w} {full}" for w in ASKED for x, full in (("re", "are"), ("ve", "have"), ("ll", "will"))}
    # have after a modal, after a negated one and after would or will
    out |= {f"{v}'ve": f"{v} have" for v in MODALS}
    out |= {f"{k}'ve": f"{x} have" for k, x in out.items() if k.endswith(("n't", "'d", "'ll")) and k.split("n't")[0] in [*MODALS, "ca", *PRONOUNS] or k in [p + e for p in PRONOUNS for e in ("'d", "'ll")]}
    return out | {k.replace("'", ""): v for k, v in out.items() if "'" in k and k not in AMBIGUOUS}


CONTRACTIONS = contractions()


def expanded(text: Column) -> Column:
    """Contractions spelled out, word by word, a capital at the start kept; others stay."""
    table = F.create_map(*[F.lit(x) for kv in CONTRACTIONS.items() for x in kv])

    def whole(w: Column) -> Column:
        found = F.try_element_at(table, F.lower(w))
        first = F.substr(w, F.lit(1), F.lit(1))
        capital = F.concat(F.upper(F.substr(found, F.lit(1), F.lit(1))), F.substr(found, F.lit(2), F.length(found)))
        return F.coalesce(F.when(first != F.lower(first), capital).otherwise(found), w)

    return F.array_join(F.transform(F.split(text, " "), whole), " ")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def plain_apostrophes(text: Column) -> Column:
    """Curly quotes straight, and no space before an apostrophe."""
    return F.regexp_replace(F.translate(text, "’‘", "''"), r" +'", "'")


def without_sense(name: Column) -> Column:
    """dog.n.01 -> dog; names without a sense stay."""
    return F.regexp_replace(name, r"^(.+)\.[a-z]+\.[0-9]+$", "$1")


def topic_of(path: Column) -> Column:
    """A file's or rule's first word as a topic."""
    return F.concat(F.lit("topic_"), F.split(F.regexp_extract(path, r"([^/]+?)(?:\.[a-z]+)?$", 1), "_")[0])
