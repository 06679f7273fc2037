"""Entities, relations and time-bounded facts."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scan as SC
from ..functions import text as T
from .retrieval import match_terms


def _named(names: Column, label: str, confidence: float) -> Column:
    return F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lower(x).alias("key")))


def _found(text: Column, expression: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(expression), F.lit(group))


def _substrings(low: Column, words: list[str]) -> Column:
    """The words that the text holds anywhere."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(w.title())) for w in words]))


def _whole_words(low: Column, words: list[str], apart: Column | None = None) -> Column:
    """The words between boundaries: each is looked for as a substring (or told by a bit of `apart`), and for boundaries only in texts that hold it."""
    held = lambda i, w: F.contains(low, F.lit(w)) if apart is None else SC.bit(apart, i)
    whole = lambda w: low.rlike(rf"(?U){re.escape(w)}\b(?<=\b{re.escape(w)})")
    return F.array_compact(F.array(*[F.when(held(i, w) & whole(w), F.lit(w)) for i, w in enumerate(words)]))


def _in_context(text: Column, low: Column, expression: str) -> Column:
    """Capitalised names of more than two characters that a phrase follows; whether there is such a phrase is tested on the folded text first."""
    phrase = _context_phrase(expression)
    hits = F.filter(_found(text, expression, 1), lambda x: (F.length(x) > 2) & x.rlike(r"^\p{Lu}"))
    return F.when(T.any_of(low, T.cues([phrase])) & low.rlike(r"(?U)\w" + phrase), hits).otherwise(F.array().cast("array<string>"))


def _found_if(text: Column, low: Column, expression: str) -> Column:
    """All matches of a case-insensitive expression; the folded text, which is faster to test, says whether there is one."""
    plain = re.sub(r"^\(\?i?u?\)", "", expression)
    held = T.cues([plain])
    possible = T.any_of(low, held) if held else low.rlike(T.fold_expression(plain))
    return F.when(possible, _found(text, expression)).otherwise(F.array().cast("array<string>"))


def _first_of_each(found: Column) -> Column:
    """V9: of equal names (whatever their case) the first."""
    keys = F.transform(found, lambda x: x["key"])
    return T.bound(keys, lambda k: F.filter(found, lambda x, i: F.array_position(k, x["key"]) == i + 1))


def _context_phrase(expression: str) -> str:
    """What follows a name, as folded texts have it."""
    return T.fold_expression(expression[expression.index(")", 6) + 1 :])


def _entity_signs(text: Column) -> Column:
    """One pass a kind tells which kinds of entities a text can have; text_entities() looks for no others."""
    cued = lambda e: SC.one_of_folded(T.cues([e]))
    any_of = lambda es: "|".join(SC.for_lower_case(T.fold_expression(re.sub(r"^\(\?i?u?\)", "", e))) for e in es)
    person = f"[A-ZÇĞİÖŞÜ][a-zçğıöşü]+{SC.SPACE}+[A-ZÇĞİÖŞÜ][a-zçğıöşü]"
    tests = [(True, person), (False, cued(_context_phrase(P.PERSON_CONTEXT))), (False, SC.one_of(P.PLACES)), (False, cued(_context_phrase(P.PLACE_CONTEXT))), (False, SC.one_of(P.ORGANISATIONS))]
    tests += [(False, any_of(P.PRODUCTS)), (False, any_of(P.DATES)), (True, r"\d{3}\)?[\s\x0b-]?\d{3}"), (True, "@")]
    return SC.entity_signs(text, F.lower(text), tests, P.TECH)


def text_entities(text: Column, found: Column | None = None) -> Column:
    """Array of (name, label, confidence, key) in the order persons, places, organisations, tech, products, dates, contacts. found: _entity_signs()."""
    text = F.coalesce(text, F.lit(""))
    every = T.bound(F.lower(text), lambda low: T.bound(T.folded(text), lambda fold: _text_entities(text, low, fold, found)))
    return every if found is None else F.when(found["held"] == 0, F.array().cast(_ENTITIES)).otherwise(every)


_ENTITIES = "array<struct<name:string,label:string,confidence:double,key:string>>"


def scanned_entities(text: Column) -> Column:
    """text_entities(), the kinds told by a scan first; not for use inside another function of arrays."""
    return T.bound(_entity_signs(text), lambda found: text_entities(text, found))


def _text_entities(text: Column, low: Column, fold: Column, found: Column | None) -> Column:
    held = lambda i, names, kind=_ENTITIES: names if found is None else F.when(SC.bit(found["held"], i), names).otherwise(F.array().cast(kind))
    some = lambda test, names: F.when(text.rlike(test), names).otherwise(F.array().cast("array<string>"))
    persons = F.concat(
        held(0, _named(some(r"(?U)[A-ZÇĞİÖŞÜ][a-zçğıöşü]+\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]", _found(text, P.PERSON, 1)), "person", 0.7)),
        held(1, _named(_in_context(text, fold, P.PERSON_CONTEXT), "person", 0.6)),
    )
    places = F.concat(held(2, _named(_substrings(low, P.PLACES), "place", 1.0)), held(3, _named(_in_context(text, fold, P.PLACE_CONTEXT), "place", 0.6)))
    phones = _named(some(r"\d{3}\)?[\s-]?\d{3}", _found(text, P.PHONE)), "phone", 0.9)
    return F.concat(
        _first_of_each(persons),
        _first_of_each(places),
        held(4, _named(_substrings(low, P.ORGANISATIONS), "org", 1.0)),
        held(9, _named(_whole_words(low, P.TECH, None if found is None else found["apart"]), "tech", 0.9)),
        held(5, _first_of_each(F.concat(*(_named(_found_if(text, fold, e), "product", 0.9) for e in P.PRODUCTS)))),
        held(6, _first_of_each(F.concat(*(_named(_found_if(text, fold, e), "date", 0.8) for e in P.DATES)))),
        _first_of_each(F.concat(held(7, phones), held(8, _named(F.when(F.contains(text, F.lit("@")), _found(text, P.EMAIL)).otherwise(F.array().cast("array<string>")), "email", 0.9)))),
    )


def entities(memories: DataFrame) -> DataFrame:
    """Id, created_at, label, key, name, confidence; one row a text, label and case-folded name (V9). No shuffle: a text's entities are found and made distinct in its row."""
    rows = memories.select("id", "created_at", F.explode(scanned_entities(F.col("text"))).alias("e"))
    return rows.select("id", "created_at", "e.label", "e.key", "e.name", "e.confidence")


def entity_table(found: DataFrame) -> DataFrame:
    """One row an entity with its mentions."""
    return found.groupBy("key", "label").agg(F.min("name").alias("name"), F.count("*").alias("mentions"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def cooccurrences(found: DataFrame) -> DataFrame:
    """Pairs of entities in one text, in the canonical order of label and name."""
    e = F.array_sort(F.collect_list(F.struct("label", "key")))
    lists = found.groupBy("id", "created_at").agg(e.alias("e"))  # the entities of one text
    a = lists.select("id", "created_at", "e", F.posexplode("e").alias("i", "a"))
    b = a.select("id", "created_at", "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    return b.select("id", "created_at", F.col("a.key").alias("source_id"), F.col("b.key").alias("target_id"))


def strengthen(edges: DataFrame, order: str) -> DataFrame:
    """First confidence, +0.1 a repeat up to 1, the last context."""
    first = F.min_by("confidence", order)
    return edges.groupBy("source_id", "target_id", "relation_type").agg(F.round(F.least(F.lit(1.0), first + 0.1 * (F.count("*") - 1)), 6).alias("confidence"), F.max_by("context", order).alias("context"), F.count("*").alias("n"))


def degrees(edges: DataFrame, most: int = 10) -> DataFrame:
    """Entities by the number of their edges, either end."""
    ends = edges.select(F.col("source_id").alias("id")).unionAll(edges.select(F.col("target_id").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(most)


def cooccurrence_links(memories: DataFrame) -> DataFrame:
    """Id, source_id, target_id, relation_type, confidence, context: the pairs of a text's entities under their canonical names.

    Two tech words use each other (0.6), other pairs are mentioned together (0.5). The pairs of a text are made in its row.
    """
    kinds = F.transform(scanned_entities(F.col("text")), lambda e: F.struct(e["label"].alias("label"), F.lower(T.resolve_alias(e["name"])).alias("key")))
    lists = memories.select("id", F.substring("text", 1, 200).alias("context"), F.array_sort(kinds).alias("e")).where(F.size("e") > 1)
    pairs = lists.select("id", "context", "e", F.posexplode("e").alias("i", "a")).select("id", "context", "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))
    tech = (F.col("a.label") == "tech") & (F.col("b.label") == "tech")
    return pairs.select("id", F.col("a.key").alias("source_id"), F.col("b.key").alias("target_id"), F.when(tech, "uses").otherwise("mentioned_with").alias("relation_type"), F.when(tech, 0.6).otherwise(0.5).alias("confidence"), "context")


def knowledge(memories: DataFrame, margin: float = 0.20, relations: bool = True) -> tuple[DataFrame, DataFrame]:
    """T33 as one chain: the edges (source_id, target_id, relation_type, confidence, context, n) and the folded facts of the memories.

    Links of a text's entities (T30, T32, J12) and, unless left out, its typed relations (T31) become edges, which every repeat
    strengthens in order of time (A24). Typed relations are facts besides; exclusive ones meet conflicts in that order (L10).
    """
    at = memories.select("id", F.struct("created_at", "id").alias("_at"))
    links = cooccurrence_links(memories).join(at, "id").select("source_id", "target_id", "relation_type", "confidence", "context", "_at")
    typed = typed_relations(memories).join(memories.select("id", "created_at", F.substring("text", 1, 200).alias("context")), "id")
    if relations:
        links = links.unionByName(typed.select(F.lower("subject").alias("source_id"), F.lower("object").alias("target_id"), "relation_type", "confidence", "context", F.struct("created_at", "id").alias("_at")))
    facts = typed.select(F.xxhash64("id", "subject", "relation_type", "object").alias("id"), F.lower("subject").alias("entity_id"), "relation_type", F.col("object").alias("object_value"), "confidence", F.timestamp_seconds("created_at").alias("valid_from"))
    return strengthen(links, "_at"), fold_conflicts(facts, margin)


def _relation(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), T.trimmed(x["s"]).alias("s"), T.trimmed(x["o"]).alias("o"))


def text_relations(text: Column) -> Column:
    """Array of (relation_type, subject, object): all matches of all expressions; an expression runs only on texts that hold one of its words.

    A subject or object that is an entity of the text takes that entity's name, other subjects their canonical one.
    """
    flat = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    none = F.array().cast("array<struct<kind:string,s:string,o:string>>")

    def found(flat: Column, low: Column) -> Column:
        each = []
        for kind, expressions in P.RELATIONS.items():
            for e, cues in expressions:
                pairs = F.arrays_zip(_found(flat, "(?iU)" + e, 1).alias("s"), _found(flat, "(?iU)" + e, 2).alias("o"))
                hits = F.transform(pairs, _relation(kind))
                behind = T.fold_expression(e[T.closing(e, 2) + 1 :].removeprefix(r"\b"))  # what follows the subject, cheaper to test
                possible = T.any_of(low, [T.fold_expression(c) for c in cues]) & low.rlike("(?U)" + behind)
                each.append(F.when(possible, hits).otherwise(none))
        return F.concat(*each)

    def named(raw: Column, known: Column) -> Column:
        return F.try_element_at(F.filter(known, lambda e: e["key"] == F.lower(raw)), F.lit(-1))["name"]

    def resolved(hits: Column) -> Column:
        return T.bound(text_entities(text), lambda known: F.transform(hits, lambda x: F.struct(x["kind"].alias("relation_type"), F.coalesce(named(x["s"], known), T.resolve_alias(x["s"])).alias("subject"), F.coalesce(named(x["o"], known), x["o"]).alias("object"))))

    hits = T.bound(flat, lambda flat: T.bound(T.folded(flat), lambda low: found(flat, low)))
    empty = F.array().cast("array<struct<relation_type:string,subject:string,object:string>>")
    return T.bound(hits, lambda h: F.when(F.size(h) > 0, resolved(h)).otherwise(empty))


def typed_relations(memories: DataFrame) -> DataFrame:
    """Id, relation_type, subject, object, confidence."""
    rows = memories.select("id", F.explode(text_relations(F.col("text"))).alias("r"))
    return rows.select("id", "r.relation_type", "r.subject", "r.object", F.lit(0.8).alias("confidence"))


def facts_as_of(facts: DataFrame, day: str) -> DataFrame:
    """Facts valid on a day (half-open interval)."""
    at = F.to_date(F.lit(day))
    return facts.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def conflict_groups(facts: DataFrame) -> DataFrame:
    """Entity and exclusive relation with more than one active value, values in order."""
    active = facts.where(F.col("relation_type").isin(P.EXCLUSIVE_RELATIONS) & F.col("valid_to").isNull())
    return active.groupBy("entity_id", "relation_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("object_value")), "|").alias("held")).where("n > 1")


class _Active:
    """Active facts of one key in their order, with the least mark (confidence and margin) over any stretch of them.

    A tree of stretches: each holds its least mark, that one's value, and the least mark among its other values, so the
    first fact of another value below a mark is found in logarithmic time. Closed facts are dropped when the tree is full.
    """

    NONE = (math.inf, None, math.inf)

    def __init__(self, kept: list[tuple] = (), size: int = 16):
        self.size, self.facts = size, list(kept)
        self.tree = [self.NONE] * (2 * size)
        for i, (_, value, mark) in enumerate(self.facts):
            self.tree[size + i] = (mark, value, math.inf)
        for i in range(size - 1, 0, -1):
            self.tree[i] = self._both(self.tree[2 * i], self.tree[2 * i + 1])

    @staticmethod
    def _both(a: tuple, b: tuple) -> tuple:
        if b[0] < a[0]:
            a, b = b, a
        return (a[0], a[1], min(a[2], b[2] if b[1] == a[1] else b[0]))

    def _set(self, i: int, node: tuple) -> None:
        i += self.size
        self.tree[i] = node
        while i := i // 2:
            self.tree[i] = self._both(self.tree[2 * i], self.tree[2 * i + 1])

    def first(self, value: str | None, below: float) -> int | None:
        holds = lambda t: (t[0] if t[1] != value else t[2]) < below
        if not holds(self.tree[1]):
            return None
        i = 1
        while i < self.size:
            i = 2 * i if holds(self.tree[2 * i]) else 2 * i + 1
        return i - self.size

    def add(self, place: int, value: str | None, mark: float) -> None:
        if len(self.facts) == self.size:
            kept = [f for f in self.facts if f is not None]
            self.__init__(kept, self.size * 2 if 2 * len(kept) > self.size else self.size)
        self.facts.append((place, value, mark))
        self._set(len(self.facts) - 1, (mark, value, math.inf))

    def close(self, i: int) -> int:
        place, self.facts[i] = self.facts[i][0], None
        self._set(i, self.NONE)
        return place


def fold_conflicts(facts: DataFrame, margin: float = 0.20) -> DataFrame:
    """Facts of an entity and relation in order of (valid_from, id): a differing fact closes the first active one
    that it beats by more than the margin; meeting one that it doesn't beat flags it. Adds active, closed_by, flagged.

    Only exclusive relations fold; others pass. Rows stream through in the order of their key; a task holds the active facts
    of one key, as numbers. What closes a fact is joined to it by an aggregation on its place, which spreads a hot key.
    A null confidence neither beats nor is beaten; null values equal each other.
    """
    key = ["entity_id", "relation_type"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, active, codes, n = None, _Active(), {}, 0
        for pdf in batches:
            out = []
            for id, entity, relation, held, confidence in zip(*(pdf[c] for c in ("id", *key, "object_value", "confidence")), strict=True):
                if current != (entity, relation):
                    current, active, codes, n = (entity, relation), _Active(), {}, 0
                value = codes.setdefault(held.lower() if held is not None else None, len(codes))
                known = confidence is not None and confidence == confidence
                met, beaten = active.first(value, math.inf), active.first(value, confidence) if known else None
                if beaten is not None:
                    out.append((None, entity, relation, active.close(beaten), None, None, id))
                out.append((id, entity, relation, n, held, met != beaten, None))
                active.add(n, value, confidence + margin if known else sys.float_info.max)
                n += 1
            yield pd.DataFrame(out, columns=["id", *key, "place", "object_value", "flagged", "closed_by"]).astype({"id": "Int64", "closed_by": "Int64", "flagged": "boolean"})

    exclusive = facts.where(F.col("relation_type").isin(P.EXCLUSIVE_RELATIONS)).select("id", *key, "object_value", "confidence", "valid_from")
    ordered = exclusive.repartition(*key).sortWithinPartitions(*key, "valid_from", "id", "object_value", "confidence")
    events = ordered.mapInPandas(fold, "id long, entity_id string, relation_type string, place long, object_value string, flagged boolean, closed_by long")
    folded = events.groupBy(*key, "place").agg(*[F.max(c).alias(c) for c in ("id", "object_value", "flagged", "closed_by")])
    folded = folded.select("id", *key, "object_value", F.col("closed_by").isNull().alias("active"), "closed_by", "flagged")
    rest = facts.where(~F.col("relation_type").isin(P.EXCLUSIVE_RELATIONS)).select("id", *key, "object_value", F.lit(True).alias("active"), F.lit(None).cast("long").alias("closed_by"), F.lit(False).alias("flagged"))
    return folded.unionByName(rest)


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of the given entities, seen from either end."""
    turned = [F.col({"source_id": "target_id", "target_id": "source_id"}.get(c, c)).alias(c) for c in edges.columns]
    both = edges.unionByName(edges.select(*turned))
    return both.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi")


def match_names(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Terms (query_id, term) and entities (id, name; ids are unique) whose name contains the term, by postings. Empty terms match nothing."""
    return match_terms(terms, names).select("query_id", "term", "id", "name")
