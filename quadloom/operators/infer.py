"""Rule inference: matches of a rule's precondition become facts, with ids and provenance that depend on the evidence alone."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.closure import MERGE
from quadloom.operators.match import edge_rows, is_variable, match, with_mark, without_doubt
from quadloom.operators.mutate import FACT
from quadloom.sources.staging import staged


@dataclass(frozen=True)
class Rule:
    """pre and post are patterns; each pre edge may name its predicate id. confidence: of a pre predicate id, 'sure' (no
    mark), 'not', 'maybe' or 'any'. var_types: types that variables must have."""

    name: str
    pre: list[tuple]
    post: list[tuple]
    confidence: dict[str, str] = field(default_factory=dict)
    var_types: dict[str, str] = field(default_factory=dict)


def named_ids(pattern: list[tuple]) -> list[tuple]:
    """Every edge with a variable for its predicate id."""
    return [e if len(e) == 4 else (*e, f"?_e{i}") for i, e in enumerate(pattern)]


def solutions(quads: DataFrame, rule: Rule, types: DataFrame | None = None) -> DataFrame:
    """A row for each solution of the precondition; predicates without a stated confidence must be sure."""
    return settled(match(quads, named_ids(rule.pre), types, rule.var_types), quads, rule)


def settled(out: DataFrame, quads: DataFrame, rule: Rule, marks: list[DataFrame] | None = None) -> DataFrame:
    """The rows of matched preconditions whose predicates have the confidence that the rule asks for.

    marks: a table for each edge that must be marked (marked()), in which its mark is looked for; quads if not given.
    """
    tables = iter(marks or [])
    for pid, want in conditions(rule):
        if want == "sure":
            out = without_doubt(out, quads, pid)
        elif want != "any":
            out = with_mark(out, next(tables, quads), want, pid)
    return out


def conditions(rule: Rule) -> list[tuple[str, str]]:
    """(predicate id variable, confidence) of every precondition edge whose id is a variable."""
    return [(e[3][1:], rule.confidence.get(e[3][1:], "sure")) for e in named_ids(rule.pre) if is_variable(e[3])]


def marked(rule: Rule) -> list[str]:
    """The marks that a solution needs: 'not' or 'maybe' for each edge that must have one."""
    return [want for _, want in conditions(rule) if want not in ("sure", "any")]


def evidence(rule: Rule):
    """The sorted ids of the facts behind a solution, as one string."""
    ids = [F.col(e[3][1:]) if is_variable(e[3]) else F.lit(e[3]) for e in named_ids(rule.pre)]
    return F.array_join(F.array_sort(F.array(*ids)), "&")


def apply(found: DataFrame, rule: Rule) -> DataFrame:
    """Facts (FACT, rule, evidence) of the postcondition for each solution; ids come from the rule and what is said."""
    term = lambda x: F.col(x[1:]) if is_variable(x) else F.lit(x).cast("string")
    out = None
    for edge in rule.post:
        s, t, o = (term(x) for x in edge[:3])
        pid = term(edge[3]) if len(edge) == 4 else F.concat(F.lit(f"{rule.name}:"), F.substring(F.sha2(F.concat_ws("|", s, t, F.coalesce(o, F.lit(""))), 256), 1, 20))
        rows = found.select("graph_id", s.alias("s"), t.alias("t"), o.alias("o"), pid.alias("pid"), F.lit(rule.name).alias("rule"), evidence(rule).alias("evidence"))
        out = rows if out is None else out.union(rows)
    return out


def unfired(made: DataFrame, fired: DataFrame) -> DataFrame:
    """One firing for each graph, rule and evidence set that isn't in fired (graph_id, rule, evidence)."""
    return made.dropDuplicates(["graph_id", "rule", "evidence", "pid"]).join(fired, ["graph_id", "rule", "evidence"], "left_anti")


def provenance(made: DataFrame) -> DataFrame:
    """Links (src, dst, label): each evidence fact to a node for the firing, and that to what follows."""
    node = F.concat("rule", F.lit("@"), F.substring(F.sha2("evidence", 256), 1, 16))
    rows = made.select(node.alias("node"), "evidence", "pid").distinct()
    causes = rows.select(F.explode(F.split("evidence", "&")).alias("src"), F.col("node").alias("dst"), F.lit("and").alias("label"))
    return causes.union(rows.select("node", "pid", F.lit("implies"))).distinct()


def chain(quads: DataFrame, rules: Iterable[Rule], rounds: int | None = None, types: DataFrame | None = None, stratified: bool = False) -> DataFrame:
    """Facts that follow in so many rounds, or in as many as bring something new: (FACT) of what wasn't there before.

    A fact is new when no fact of its graph says the same, whatever its id; of several made at once the smallest id stays. Semi-naive: after the first round a
    precondition is matched once for each of its edges and each mark that it asks for, that one among the last round's facts alone,
    those before it among older facts and those after it among all, so no solution is found twice. Marks only take solutions
    away from edges that must be sure, so no fresh mark brings any there.

    A fact that is marked not or maybe later keeps what was derived from it before. stratified: rules that derive marks
    end before rules that need the marked facts sure, the rounds counting for each stratum; a cycle is an error (strata()).
    """
    rules = list(rules)
    if stratified:
        made, known = [], quads.select(FACT)
        for layer in strata(rules):
            made.append(chain(known, layer, rounds, types))
            known = known.union(made[-1])
        return reduce(DataFrame.union, made) if made else quads.select(FACT).limit(0)
    known = staged(quads.select(FACT))
    says = lambda q: q.select("graph_id", "s", "t", F.coalesce("o", F.lit("")).alias("oo")).distinct()
    parts, older, fresh = [], None, None
    constants = sorted({t for r in rules for t in [*(e[1] for e in r.pre), *marked(r)] if not is_variable(t)})
    for n in count(1):
        if rounds is not None and n > rounds:
            break
        made = None
        # the rules' own predicate types that the last round brought: what needs another can't be new
        now = None if fresh is None else {r.t for r in fresh.where(F.col("t").isin(constants)).select("t").distinct().collect()}
        for rule in rules:
            found = solutions(known, rule, types) if now is None else _new_solutions(older, fresh, known, rule, types, now)
            if found is None:
                continue
            rows = apply(found, rule).select(FACT)
            made = rows if made is None else made.union(rows)
        if made is None:
            break
        made = made.groupBy("graph_id", "s", "t", "o").agg(F.min("pid").alias("pid")).withColumn("oo", F.coalesce("o", F.lit("")))
        fresh = staged(made.join(says(known), ["graph_id", "s", "t", "oo"], "left_anti").select(FACT))
        if fresh.isEmpty():
            break
        parts.append(fresh)
        older, known = known, known.union(fresh)
        if n % MERGE == 0:
            known = staged(known)
    return reduce(DataFrame.union, parts) if parts else quads.select(FACT).limit(0)


def _new_solutions(older: DataFrame, fresh: DataFrame, known: DataFrame, rule: Rule, types: DataFrame | None, now: set[str]) -> DataFrame | None:
    """Solutions over known that use at least one fact or mark of fresh; known is older and fresh together. now: types that fresh has."""
    pre, marks = named_ids(rule.pre), marked(rule)
    kinds = [e[1] for e in pre] + marks
    out = None
    for i, kind in enumerate(kinds):
        if not is_variable(kind) and kind not in now:
            continue
        tables = [older if j < i else fresh if j == i else known for j in range(len(kinds))]
        rows = settled(match(tables[: len(pre)], pre, types, rule.var_types), known, rule, tables[len(pre) :])
        out = rows if out is None else out.unionByName(rows)
    return out


def strata(rules: list[Rule]) -> list[list[Rule]]:
    """Rules in layers, so that what may mark a fact as doubted is in an earlier layer than what needs such facts sure.

    A rule comes no earlier than those that derive a type of its edges, or a mark that it asks for; and later than those that may mark
    a type of its sure edges. A ValueError where a rule would have to come before itself.
    """
    any_ = "?"
    kind = lambda t: any_ if is_variable(t) else t
    meet = lambda a, b: any_ in (a | b) if a and b and any_ in a | b else bool(a & b)

    def of_id(rule: Rule, pid) -> set[str]:
        named = {kind(e[1]) for e in [*named_ids(rule.pre), *(e for e in rule.post if len(e) == 4)] if e[3] == pid}
        return named or {any_}

    derives = [{kind(e[1]) for e in r.post} for r in rules]
    doubts = [set().union(*(of_id(r, e[0]) for e in r.post if kind(e[1]) in ("not", "maybe", any_))) for r in rules]
    reads = [{kind(e[1]) for e in r.pre} | set(marked(r)) for r in rules]
    sure = [{kind(e[1]) for e in named_ids(r.pre) if not is_variable(e[3]) or r.confidence.get(e[3][1:], "sure") == "sure"} for r in rules]
    level = [0] * len(rules)
    for _ in range(len(rules) + 1):
        before = list(level)
        for i in range(len(rules)):
            for j in range(len(rules)):
                if meet(reads[i], derives[j]):
                    level[i] = max(level[i], level[j])
                if meet(sure[i], doubts[j]):
                    level[i] = max(level[i], level[j] + 1)
        if level == before:
            return [[r for r, n in zip(rules, level, strict=True) if n == k] for k in sorted(set(level))]
        if max(level) > len(rules):
            break
    raise ValueError("rules that doubt facts depend on facts that must be sure, in a cycle: " + ", ".join(r.name for r, n in zip(rules, level, strict=True) if n == max(level)))


def of_class(pairs: DataFrame, types: DataFrame, specific: bool) -> DataFrame:
    """Rows (.., x) of pairs whose x is a class itself, or, specific, lies strictly below the column `kind`."""
    if not specific:
        return pairs.where(F.col("x") == F.col("kind"))
    below = types.where("c <> sup").select(F.col("c").alias("x"), F.col("sup").alias("kind"))
    return pairs.join(below, ["x", "kind"], "left_semi")


def virtual_types(nodes: DataFrame, types: DataFrame, quads: DataFrame) -> DataFrame:
    """(s, o, pid): type facts of the nodes (c) that are implied but not stored."""
    stored = quads.where("t = 'type'").select(F.col("s").alias("c"), F.col("o").alias("sup"))
    implied = types.where("c <> sup").join(nodes, "c", "left_semi").join(stored, ["c", "sup"], "left_anti")
    return implied.select(F.col("c").alias("s"), F.col("sup").alias("o"), F.concat(F.lit("virtual:"), "c", F.lit("|"), "sup").alias("pid"))


def affirmed(quads: DataFrame, pids: DataFrame) -> DataFrame:
    """quads where the given facts (graph_id, pid) carry no doubt any more."""
    marks = quads.where(F.col("t").isin("not", "maybe")).join(pids.withColumnRenamed("pid", "s"), ["graph_id", "s"], "left_semi").select("graph_id", "pid")
    return quads.join(marks, ["graph_id", "pid"], "left_anti").select(FACT)


def rejected(quads: DataFrame, pids: DataFrame) -> DataFrame:
    """quads where the given facts (graph_id, pid) are denied: marked not, and no longer maybe."""
    of = pids.withColumnRenamed("pid", "s")
    marks = quads.where("t = 'maybe'").join(of, ["graph_id", "s"], "left_semi").select("graph_id", "pid")
    denied = quads.where("t = 'not'").select("graph_id", "s")
    facts = quads.select("graph_id", F.col("pid").alias("s")).join(of, ["graph_id", "s"], "left_semi").join(denied, ["graph_id", "s"], "left_anti")
    new = facts.select("graph_id", "s", F.lit("not").alias("t"), F.lit(None).cast("string").alias("o"), F.concat(F.lit("q:"), "s", F.lit("|not|")).alias("pid"))
    return quads.join(marks, ["graph_id", "pid"], "left_anti").select(FACT).union(new)


__all__ = ["Rule", "solutions", "apply", "chain", "provenance", "unfired", "edge_rows"]
