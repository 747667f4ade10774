"""Draft compilation: envelopes of drafted items become canonical rows, or rows of refusals that say why.

An envelope is a JSON text with the lists entities, claims, events, ideas and questions. Each item is compiled for
itself; a refused item costs no other one. Schema rules are columns over the item as a VARIANT, so only what breaks
them is refused. Accepted items and refused ones are the same table, told apart by ``status``.

Defined results: a null envelope has no items; one that is no JSON object, or whose entities hold an unsupported
legacy type, is one refused item of section 'envelope'; a section that is no list is empty; items keep their places.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import registry
from ..functions.text import fold, normalize_predicate
from .evaluate import ratio
from .predicates import DEFAULT, Predicates, canonical_type, end_problem, fixed, let, lookup, resolve, strip, suggested

SECTIONS = ("entities", "claims", "events", "ideas", "questions")
NAMES = dict(zip(SECTIONS, ("entity", "claim", "event", "idea", "question")))


def canonical_word(c: Column, words: tuple[str, ...], aliases: dict[str, str]) -> Column:
    """A word of a closed list, or what a declared alias stands for; null where it is neither."""
    w = F.lower(strip(c))
    return F.when(w.isin(*words), w).otherwise(lookup(aliases, w))


def compile_claims(drafts: DataFrame, limit: int = 5, known: Predicates = DEFAULT) -> DataFrame:
    """Drafts (subject, predicate, object, claim_type, polarity, modality, temporal_signal, context_note, subject_types, object_types, resolution_text) with resolution, status, reasons and claim.

    ``claim`` is there only where status is compiled. The first problem decides: an unresolved predicate, an unknown claim
    type, polarity or modality, types that don't fit at the subject or the object, and a quality verdict (the columns
    ``verdict`` and ``quality_reasons``, if there) of reject; a verdict of review compiles with a remark.
    """
    c = F.col
    blank = lambda x: F.coalesce(x.cast("string"), F.lit("")) == ""
    parts = [F.when(~blank(c(n)), c(n)) for n in ("subject", "predicate", "object", "context_note")]
    drafts = drafts.withColumn("_text", F.when(~blank(c("resolution_text")), c("resolution_text")).otherwise(strip(F.concat_ws(" ", *parts))))
    df = resolve(drafts, "predicate", "_text", limit, known)
    enums = {}
    problem = None
    for name, default, words, aliases in (("claim_type", "factual", registry.CLAIM_TYPES, registry.CLAIM_TYPE_ALIASES), ("polarity", "positive", registry.POLARITIES, registry.POLARITY_ALIASES), ("modality", "asserted", registry.MODALITIES, registry.MODALITY_ALIASES)):
        given = F.when(blank(c(name)), default).otherwise(c(name))
        enums[name] = canonical_word(given, words, aliases)
        wrong, why = enums[name].isNull(), F.concat(F.lit(f"Unsupported {name.replace('_', ' ')}: "), given)
        problem = F.when(wrong, why) if problem is None else problem.when(wrong, why)
    predicate = c("resolution.predicate")
    ends = F.array_compact(F.array(end_problem(c("subject_types"), predicate, False, known), end_problem(c("object_types"), predicate, True, known)))
    unsupported = F.filter(ends, lambda p: p != "domain_range_violation")
    problem = problem.when(F.size(ends) > 0, F.coalesce(F.get(unsupported, F.lit(0)), F.get(ends, F.lit(0))))
    verdict = c("verdict") if "verdict" in drafts.columns else F.lit(None).cast("string")
    more = c("quality_reasons") if "quality_reasons" in drafts.columns else F.array().cast("array<string>")
    df = fixed(df, "_given", F.struct(problem.alias("problem"), *[e.alias(n) for n, e in enums.items()]))
    compiled = (c("resolution.status") == "resolved") & c("_given.problem").isNull() & (F.coalesce(verdict, F.lit("")) != "reject")
    status = F.when(c("resolution.status") != "resolved", "unresolved").when(~compiled, "rejected").otherwise("compiled")
    reasons = F.when(c("resolution.status") != "resolved", F.array("resolution.reason")).when(c("_given.problem").isNotNull(), F.array("_given.problem")).when(verdict == "reject", F.concat(F.array(F.lit("quality_gate_rejected")), F.coalesce(more, F.array().cast("array<string>")))).when(verdict == "review", F.array(F.lit("quality_gate_review"))).otherwise(F.array().cast("array<string>"))
    signal = F.when(blank(c("temporal_signal")), c("resolution.temporal_signal")).otherwise(c("temporal_signal"))
    signal = F.when(signal.isin(*registry.TEMPORAL_SIGNALS), signal)
    subject = strip(F.regexp_replace(F.coalesce(c("subject"), F.lit("")), r"(?U)\s+", " "))
    claim = F.struct(subject.alias("subject"), predicate.alias("predicate"), F.when(~blank(c("object")), c("object")).alias("object"), *[c(f"_given.{n}").alias(n) for n in enums], signal.alias("temporal_signal"))
    done = fixed(df, "_done", F.struct(status.alias("status"), reasons.alias("reasons"), F.when(compiled, claim).alias("claim")))
    return done.select("*", "_done.*").drop("_text", "_given", "_done")


# items of envelopes


def _get(item: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(item, f"$.{path}", kind)


def _kind_of(v: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    kinds = lambda n: F.when(n == "STRING", "string").when(n == "VOID", "null").when(n.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT"), "number").otherwise(F.lower(n))
    return F.when(v.isNotNull(), let(name, kinds))


def _fields(item: Column) -> Column:
    """(item, kinds) of an item: with the kind of each of its own fields, so that rules read it once and not once each."""
    own = F.try_variant_get(item, "$", "map<string,variant>")
    return F.struct(item.alias("item"), F.transform_values(own, lambda _, v: _kind_of(v)).alias("kinds"))


def _kind(x: Column, path: str) -> Column:
    """string, number, boolean, array, object, null, or SQL's null where there is no such field; of ``_fields`` of an item."""
    return _kind_of(F.try_variant_get(x["item"], f"$.{path}", "variant")) if "." in path else x["kinds"][path]


def _text(x: Column, path: str) -> Column:
    """A string that isn't empty."""
    return (F.coalesce(_kind(x, path), F.lit("")) == "string") & (F.length(_get(x["item"], path)) > 0)


def _text_or_null(x: Column, path: str) -> Column:
    return F.coalesce(_kind(x, path), F.lit("null")).isin("string", "null")


def _one_of(x: Column, path: str, words) -> Column:
    return (F.coalesce(_kind(x, path), F.lit("")) == "string") & _get(x["item"], path).isin(*words)


def _share(x: Column, path: str) -> Column:
    return (F.coalesce(_kind(x, path), F.lit("")) == "number") & _get(x["item"], path, "double").between(0, 1)


def _only(fields: Column, names) -> Column:
    return F.size(F.array_except(F.map_keys(fields), F.array(*map(F.lit, names)))) == 0


def _strings(item: Column, path: str) -> Column:
    """The list at a path as strings, null where it is no list or holds anything else."""
    every = F.try_variant_get(item, f"$.{path}", "array<variant>")
    good = F.forall(every, lambda v: ~F.is_variant_null(v) & (F.schema_of_variant(v) == "STRING"))
    return F.when(every.isNotNull() & good, F.transform(every, lambda v: F.try_variant_get(v, "$", "string")))


_SOURCE = ("source_chunk", "evidence_quote")


def _sourced(x: Column) -> list[Column]:
    return [_share(x, "confidence"), *[_text(x, f) for f in _SOURCE]]


def schema_problems(item: Column, section: Column, sections=SECTIONS) -> Column:
    """Names of the schema rules that a whole item (a VARIANT object, defaults filled in) of one of the sections breaks, in the rules' order."""
    return let(_fields(item), lambda x: _broken_rules(x, section, sections))


def _broken_rules(x: Column, section: Column, sections) -> Column:
    def words(path):
        return let(_strings(x["item"], path), lambda every: every.isNotNull() & F.forall(every, lambda s: s != "") & (F.size(F.array_distinct(every)) == F.size(every)))

    is_object = lambda path: F.coalesce(_kind(x, path), F.lit("")) == "object"
    absent_or = lambda path, rule: _kind(x, path).isNull() | rule
    null_or = lambda path, names: absent_or(path, (_kind(x, path) == "null") | _one_of(x, path, names))
    time = _kind(x, "time.start").isin("string", "null") & _kind(x, "time.end").isin("string", "null") & _one_of(x, "time.precision", registry.TIME_PRECISIONS) & _only(F.try_variant_get(x["item"], "$.time", "map<string,variant>"), ("start", "end", "precision"))
    types = _strings(x["item"], "types")
    rules = {
        "entities": {
            "fields": _only(x["kinds"], ("name", "types", "aliases", "description", "properties")), "name": _text(x, "name"),
            "types": words("types") & (F.size(types) > 0) & F.forall(types, lambda t: t.isin(*registry.ENTITY_TYPES)), "aliases": words("aliases"),
            "description": _text_or_null(x, "description"), "properties": absent_or("properties", is_object("properties")),
        },
        "claims": {
            "fields": _only(x["kinds"], ("subject", "predicate", "object", "object_kind", "temporal_signal", "claim_type", "polarity", "modality", "content", "context", "confidence", *_SOURCE)),
            "subject": _text(x, "subject") & (strip(_get(x["item"], "subject")) != ""), "object": _text_or_null(x, "object"), "object_kind": null_or("object_kind", registry.OBJECT_KINDS), "content": _text_or_null(x, "content"),
        },
        "events": {
            "fields": _only(x["kinds"], ("event_type", "description", "participants", "time", "location", "status", "confidence", *_SOURCE)), "event_type": _one_of(x, "event_type", registry.EVENT_TYPES), "description": _text(x, "description"),
            "participants": _strings(x["item"], "participants").isNotNull(), "time": time, "location": _text_or_null(x, "location"), "status": _one_of(x, "status", registry.EVENT_STATUSES),
        },
        "ideas": {"fields": _only(x["kinds"], ("content", "status", "confidence", *_SOURCE)), "content": _text(x, "content"), "status": _one_of(x, "status", registry.IDEA_STATUSES)},
        "questions": {"fields": _only(x["kinds"], ("content", "question_type", "status", "confidence", *_SOURCE)), "content": _text(x, "content"), "question_type": _one_of(x, "question_type", registry.QUESTION_TYPES), "status": _one_of(x, "status", registry.QUESTION_STATUSES)},
    }
    out = F.array().cast("array<string>")
    for name, own in ((n, r) for n, r in rules.items() if n in sections):
        if name != "entities":
            own |= dict(zip(("confidence", *_SOURCE), _sourced(x)))
        if name == "claims":
            own["confidence"] |= _one_of(x, "confidence", ("unstated",))  # 0.5 in older forms
        broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), f) for f, rule in own.items()]))
        out = F.when(section == name, broken).otherwise(out)
    return out


#: What an item of an older form lacks, as JSON.
_DEFAULTS = {
    "entities": {"aliases": "[]", "description": "null", "properties": "{}"},
    "claims": {"object": "null", "claim_type": '"factual"', "polarity": '"positive"', "modality": '"asserted"', "context": "{}"},
    "events": {"participants": "[]", "location": "null", "time": '{"start":null,"end":null,"precision":"unknown"}', "status": '"unknown"', "confidence": "0.5"},
    "ideas": {"status": '"candidate"', "confidence": "0.5"},
    "questions": {"question_type": '"knowledge"', "status": '"open"', "confidence": "0.5"},
}


def items(envelopes: DataFrame, id_col: str = "id", body: str = "body", sections=("envelope", *SECTIONS)) -> DataFrame:
    """id, section, item_index, item (VARIANT) of every item of JSON envelopes, of some sections only where a step needs no others."""
    v = F.try_parse_json(F.col(body))
    df = envelopes.select(F.col(id_col).alias("id"), F.col(body).alias("body"), v.alias("v")).filter(F.col("body").isNotNull())
    whole = F.try_variant_get("v", "$", "map<string,variant>").isNotNull()  # an object
    legacy = F.exists(F.try_variant_get("v", "$.entities", "array<variant>"), lambda e: F.try_variant_get(e, "$.types", "variant").isNull() & F.try_variant_get(e, "$.type", "variant").isNotNull() & canonical_type(F.try_variant_get(e, "$.type", "string")).isNull())
    df = df.withColumn("_bad", ~whole | F.coalesce(legacy, F.lit(False)))
    rows = lambda s: F.transform(F.try_variant_get("v", f"$.{s}", "array<variant>"), lambda item, k: F.struct(F.lit(s).alias("section"), k.alias("item_index"), item.alias("item")))
    each = [rows(s) for s in SECTIONS if s in sections]
    none = F.array().cast("array<struct<section:string,item_index:int,item:variant>>")
    lone = F.array(F.struct(F.lit("envelope").alias("section"), F.lit(0).alias("item_index"), F.coalesce("v", F.to_variant_object(F.struct(F.col("body").alias("text")))).alias("item")))
    every = F.when(F.col("_bad"), lone if "envelope" in sections else none).otherwise(F.concat(none, *[F.coalesce(e, none) for e in each]))
    return df.select("id", F.explode(every).alias("x")).select("id", "x.section", "x.item_index", F.col("x.item").alias("item"))


def _whole(x, sections) -> Column:
    """An item (``x``: what ``_fields`` says of it), of these sections alone, with the defaults of its section: its JSON text is merged, not parsed by field."""
    out = F.lit(None).cast("string")
    for name in (n for n in _DEFAULTS if n in sections):
        extra = F.concat(*[F.when(_kind(x, f).isNull(), f',"{f}":{value}').otherwise("") for f, value in _DEFAULTS[name].items()])
        if name == "entities":
            typed = lambda kind: F.when(_kind(x, "types").isNull() & kind.isNotNull(), F.concat(F.lit(',"types":["'), kind, F.lit('"]'))).otherwise("")
            extra = F.concat(extra, let(canonical_type(_get(x["item"], "type")), typed))
        whole = let(F.to_json(x["item"]), lambda text: F.regexp_replace(F.concat(F.substr(text, F.lit(1), F.length(text) - 1), extra, F.lit("}")), r"^\{,", "{"))
        out = F.when(F.col("section") == name, whole).otherwise(out)
    return F.coalesce(F.try_parse_json(out), x["item"])


def _filled(df: DataFrame, sections) -> DataFrame:
    """Items, of these sections alone, with the defaults of their section. ``_kinds`` has the kind of each field."""
    is_object = F.coalesce(F.regexp_extract(F.schema_of_variant(F.col("item")), "^[A-Z]+", 0), F.lit("")) == "OBJECT"
    whole = F.when(is_object, let(_fields(F.col("item")), lambda x: _whole(x, sections))).otherwise(F.col("item"))
    df = fixed(df, "_x", F.struct(let(whole, _fields).alias("x"), is_object.alias("object")))
    return df.select("id", "section", "item_index", F.to_json("item").alias("input"), F.col("_x.x.item").alias("item"), F.col("_x.x.kinds").alias("_kinds"), F.col("_x.object").alias("_object"))


def _own(df: DataFrame, section: str) -> DataFrame:
    """Items of one section as they are, ``_kinds`` of their own fields; ``whole``, with the defaults, costs only those who read it."""
    df = fixed(df, "_kinds", _fields(F.col("item"))["kinds"])
    x = {"item": F.col("item"), "kinds": F.col("_kinds")}
    whole = F.when(F.col("_kinds").isNotNull(), _whole(x, (section,))).otherwise(F.col("item"))
    return df.select("*", F.col("_kinds").isNotNull().alias("_object"), F.to_json("item").alias("input"), whole.alias("whole"))


def entity_index(entities: DataFrame, some: Column | None = None) -> DataFrame:
    """id, key, types of entities (id, item_index, name, types, aliases): a folded name or alias; the last of a name has it, else the first of an alias.

    With ``some``, a condition: ``some_types`` is what the index of the entities that meet it has for the key, or null.
    """
    key = lambda name, rank, at: F.struct(fold(name).alias("key"), F.lit(rank).alias("rank"), at.alias("at"))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: key(a, 1, F.col("item_index")))
    keys = F.explode(F.concat(F.array(key(F.col("name"), 0, -F.col("item_index"))), aliases))
    each = entities.select("id", "types", F.lit(True) if some is None else some.alias("some"), keys.alias("k")).filter("k.key <> ''")
    order = F.struct("k.rank", "k.at")
    best = [F.min_by("types", order).alias("types")] + ([] if some is None else [F.min_by("types", F.when(F.col("some"), order)).alias("some_types")])
    return each.groupBy("id", F.col("k.key").alias("key")).agg(*best)


def _with_types(claims: DataFrame, index: DataFrame) -> DataFrame:
    """Claims (id, subject, object) with the types that their envelope's entities give to both ends; null where it knows none.

    An envelope's keys are one map, so both ends take one join; the map's side grows with the envelopes, and sizes guessed
    from compressed files must not make it a broadcast. An index with ``some_types`` gives these too.
    """
    kinds = [k for k in ("types", "some_types") if k in index.columns]
    known = lambda k: F.map_from_entries(F.collect_list(F.when(F.col(k).isNotNull(), F.struct("key", k)))).alias(f"_{k}")
    met = claims.join(index.groupBy("id").agg(*map(known, kinds)).hint("merge"), "id", "left")
    at = lambda end, k: F.col(f"_{k}")[fold(F.coalesce(F.col(end), F.lit("")))].alias(f"{end}_{k}")
    return met.select(*claims.columns, *[at(end, k) for k in kinds for end in ("subject", "object")])


def _tidy(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def _drafted_entities(raw: DataFrame) -> DataFrame:
    """Entities as drafted (of ``items``) with name, types, aliases, description, properties in canonical form, and error_code, error_message; ``usable`` ones the compiler can name, even where the schema refuses them."""
    c, item, none = F.col, F.col("item"), F.array().cast("array<string>")
    e = _own(raw, "entities")
    x = {"item": item, "kinds": c("_kinds")}
    # a name and at least one type that the registry has; an older form has one type
    types = let(canonical_type(_get(item, "type")), lambda kind: F.when(_kind(x, "types").isNull() & kind.isNotNull(), F.array(kind)).otherwise(_strings(item, "types")))
    extra = ~_only(c("_kinds"), ("name", "types", "type", "id", "aliases", "description", "properties"))
    given = F.struct(_tidy(F.coalesce(_get(item, "name"), F.lit(""))).alias("name"), F.coalesce(types, none).alias("given"), F.coalesce(_strings(item, "aliases"), none).alias("aliases"))
    e = fixed(e, "_e", given).select("*", "_e.name", F.col("_e.given").alias("_given"), F.array_distinct(F.transform("_e.given", canonical_type)).alias("types"), F.array_distinct(F.filter(F.transform("_e.aliases", _tidy), lambda a: a != "")).alias("aliases"))
    unsupported = F.get(F.filter("_given", lambda t: canonical_type(t).isNull()), F.lit(0))
    why = F.when(~c("_object"), "not an object").when(unsupported.isNotNull(), F.concat(F.lit("Unsupported entity type: "), unsupported)).when((c("name") == "") | (F.size("types") == 0), "Entity requires name and at least one type")
    # all else of the canonical form keeps the schema by how it was made
    broken = F.array_compact(F.array(F.when(extra, "fields"), F.when(F.coalesce(_kind(x, "properties"), F.lit("object")) != "object", "properties")))
    e = fixed(e, "_why", F.struct(why.alias("error"), F.when(why.isNull(), broken).alias("broken"))).withColumn("usable", c("_why.error").isNull())
    bad = c("usable") & (F.size("_why.broken") > 0)
    code = F.when(~c("usable"), "ENTITY_INVALID").when(bad, "SCHEMA_INVALID")
    message = F.when(~c("usable"), c("_why.error")).when(bad, F.concat(F.lit(_REFUSED), F.array_join("_why.broken", ", ")))
    description = F.when(_kind(x, "description") == "string", _get(item, "description"))
    properties = F.coalesce(_get(item, "properties", "variant"), F.parse_json(F.lit("{}")))
    return e.select("id", "section", "item_index", "input", "whole", "name", "types", "aliases", description.alias("description"), properties.alias("properties"), "usable", code.alias("error_code"), message.alias("error_message"))


def _drafted_claims(raw: DataFrame, index: DataFrame, limit: int, known: Predicates) -> DataFrame:
    """Claims as drafted (of ``items``) with ``claim``, ``context`` (JSON), and error_code, error_message: a quote, what the compiler says, the schema."""
    c, item = F.col, F.col("item")
    x = {"item": item, "kinds": c("_kinds")}
    text = lambda f: _get(item, f).alias(f)
    note = F.when(_kind(x, "context") == "string", _get(item, "context")).otherwise(_get(item, "context.note"))
    quote = F.coalesce(_get(item, "evidence_quote"), F.lit(""))
    fields = F.struct(_tidy(F.coalesce(_get(item, "subject"), F.lit(""))).alias("subject"), F.coalesce(_get(item, "predicate_candidate"), _get(item, "predicate")).alias("predicate"), *map(text, ("object", "claim_type", "polarity", "modality", "temporal_signal")), note.alias("context_note"), F.concat_ws(" ", F.nullif(_get(item, "content"), F.lit("")), F.nullif(quote, F.lit(""))).alias("resolution_text"), quote.alias("quote"))
    claims = fixed(_own(raw, "claims"), "_c", fields).select("id", "section", "item_index", "input", "item", "whole", "_kinds", "_object", "_c.*")
    done = compile_claims(_with_types(claims, index), limit, known)
    near = F.when(F.size("resolution.candidates") > 0, c("resolution.candidates")).otherwise(suggested(c("predicate"), 4, known))
    folded = F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c("predicate"), F.lit("None")))), "[^a-z0-9_]+", "_"), "^_+|_+$|(?<=_)_+", "")
    hint = let(near, lambda n: F.when(F.size(n) > 0, F.concat(F.lit(" Closest registered predicates: "), F.array_join(n, ", "), F.lit(" - use one of these."))).otherwise(" Use a predicate from the schema enum."))
    illegal = F.array_contains("reasons", "domain_range_violation")
    code = F.when(~c("_object"), "CLAIM_INVALID").when(c("quote") == "", "EVIDENCE_INVALID").when(c("status") == "unresolved", "UNSUPPORTED_PREDICATE").when((c("status") == "rejected") & illegal, "DOMAIN_RANGE_INVALID").when(c("status") == "rejected", "CLAIM_INVALID")
    message = F.when(~c("_object"), "not an object").when(c("quote") == "", "an evidence quote is required for every claim").when(c("status") == "unresolved", F.concat(F.lit("Unsupported claim predicate: "), folded, F.lit("."), hint)).when((c("status") == "rejected") & illegal, F.concat_ws(" ", F.lit("Claim violates ontology domain/range:"), c("subject"), c("resolution.predicate"), F.coalesce(c("object"), F.lit("(none)")))).when(c("status") == "rejected", c("reasons")[0])
    context = F.when(_kind(x, "context") == "object", F.to_json(_get(item, "context", "variant"))).when(_kind(x, "context") == "string", F.to_json(F.struct(_get(item, "context").alias("note")))).otherwise("{}")
    done = done.select("*", code.alias("error_code"), message.alias("error_message"), context.alias("context"))
    return _by_schema(done, F.struct("item", c("_kinds").alias("kinds")), ("claims",))  # no default of a claim breaks or mends a rule


def compile_items(envelopes: DataFrame, id_col: str = "id", body: str = "body", limit: int = 5, known: Predicates = DEFAULT) -> DataFrame:
    """id, section, item_index, status (ACCEPTED, REJECTED), error_code, error_message, input (JSON), compiled (JSON of the canonical item, accepted ones only), item (VARIANT).

    Codes: SCHEMA_INVALID, ENTITY_INVALID, EVIDENCE_INVALID, UNSUPPORTED_PREDICATE, DOMAIN_RANGE_INVALID, CLAIM_INVALID.
    """
    raw = lambda *sections: items(envelopes, id_col, body, sections)
    c, item = F.col, F.col("item")
    x = {"item": item, "kinds": c("_kinds")}
    row = lambda df, compiled, whole: df.select("id", "section", "item_index", "input", "error_code", "error_message", F.when(c("error_code").isNull(), compiled).alias("compiled"), c(whole).alias("item"))
    e = _drafted_entities(raw("entities"))
    entity_rows = row(e, F.to_json(F.struct("name", "types", "aliases", "description", "properties"), {"ignoreNullFields": "false"}), "whole")
    claims = _drafted_claims(raw("claims"), entity_index(e.filter("usable")), limit, known)
    claim_json = F.to_json(F.struct("claim.*", "context", F.when(_one_of(x, "confidence", ("unstated",)), 0.5).otherwise(_get(item, "confidence", "double")).alias("confidence"), *[_get(item, f).alias(f) for f in ("content", "object_kind", *_SOURCE)]), {"ignoreNullFields": "false"})
    claim_rows = row(claims, claim_json, "whole")
    later = ("events", "ideas", "questions")
    others = _filled(raw(*later), later).select("*", F.when(~c("_object"), "SCHEMA_INVALID").alias("error_code"), F.when(~c("_object"), "not an object").alias("error_message"))
    others = row(_by_schema(others, F.struct("item", c("_kinds").alias("kinds")), later), F.to_json("item"), "item")
    broken = raw("envelope").select("id", "section", "item_index", F.to_json("item").alias("input"), F.lit("ENTITY_INVALID").alias("error_code"), F.lit("not a usable envelope").alias("error_message"), F.lit(None).cast("string").alias("compiled"), "item")
    out = reduce(DataFrame.unionByName, (entity_rows, claim_rows, others, broken))
    return out.select("id", "section", "item_index", F.when(c("error_code").isNull(), "ACCEPTED").otherwise("REJECTED").alias("status"), "error_code", "error_message", "input", "compiled", "item")


_REFUSED = "rejected by extraction schema validation: "


def _by_schema(rows: DataFrame, fields: Column, sections) -> DataFrame:
    """Rows (``fields``: what ``_fields`` says of each) without an error so far get one where they break the schema's rules."""
    none = F.array().cast("array<string>")
    problems = let(fields, lambda x: _broken_rules(x, F.col("section"), sections))
    rows = fixed(rows, "_rules", F.when(F.col("error_code").isNull(), problems).otherwise(none))
    bad = F.size("_rules") > 0
    message = F.concat(F.lit(_REFUSED), F.array_join("_rules", ", "))
    return rows.withColumn("error_message", F.when(bad, message).otherwise(F.col("error_message"))).withColumn("error_code", F.when(bad, "SCHEMA_INVALID").otherwise(F.col("error_code"))).drop("_rules")


def outcomes(compiled: DataFrame) -> DataFrame:
    """id, accepted, rejected and status of each envelope that has items: COMPLETED, COMPLETED_WITH_WARNINGS, FAILED."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    out = compiled.groupBy("id").agg(n("ACCEPTED").alias("accepted"), n("REJECTED").alias("rejected"))
    return out.withColumn("status", F.when(F.col("rejected") == 0, "COMPLETED").when(F.col("accepted") > 0, "COMPLETED_WITH_WARNINGS").otherwise("FAILED"))


def accepted_entities(compiled: DataFrame) -> DataFrame:
    """id, item_index, name, types, aliases, description of the accepted entities."""
    e = F.from_json("compiled", "name string, types array<string>, aliases array<string>, description string").alias("e")
    return compiled.filter("section = 'entities' and status = 'ACCEPTED'").select("id", "item_index", e).select("id", "item_index", "e.*")


_CLAIM = "subject string, predicate string, object string, claim_type string, polarity string, modality string, temporal_signal string, context string, confidence double, content string, object_kind string, source_chunk string, evidence_quote string"


def accepted_claims(compiled: DataFrame) -> DataFrame:
    """id, item_index and the canonical fields of the accepted claims; ``context`` is JSON."""
    return compiled.filter("section = 'claims' and status = 'ACCEPTED'").select("id", "item_index", F.from_json("compiled", _CLAIM).alias("c")).select("id", "item_index", "c.*")


# relations from claims


def material_condition(context: Column) -> Column:
    """Whether a claim's context (JSON) sets a condition: one of the material keys with a value that isn't empty."""
    set_to = lambda v, k: F.coalesce(F.to_json(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("null"))
    return let(F.try_parse_json(context), lambda v: reduce(lambda a, b: a | b, [~set_to(v, k).isin("null", '""', "[]", "{}") for k in registry.MATERIAL_KEYS]))


def relation_candidates(claims: DataFrame, entities: DataFrame, known: Predicates = DEFAULT) -> DataFrame:
    """``claims`` (id, subject, predicate, object, polarity, modality, context) with outcome and reason, from the entities (id, item_index, name, types, aliases) of their envelope.

    REJECTED (an unknown subject, an unregistered predicate), CLAIM_ONLY, CONDITIONAL_RELATION or DIRECT_RELATION; the first rule that fits.
    """
    return _outcome(_with_types(claims, entity_index(entities)), known).select(*claims.columns, "outcome", "reason")


def envelope_relations(envelopes: DataFrame, id_col: str = "id", body: str = "body", limit: int = 5, known: Predicates = DEFAULT) -> DataFrame:
    """id, item_index, the canonical fields of each accepted claim of JSON envelopes, outcome and reason: ``relation_candidates`` of what ``compile_items`` accepts.

    Only entities and claims are compiled, each once; one join has the types that the compiler sees and those of accepted entities.
    """
    raw = lambda section: items(envelopes, id_col, body, (section,))
    index = entity_index(_drafted_entities(raw("entities")).filter("usable"), F.col("error_code").isNull())
    done = _drafted_claims(raw("claims"), index, limit, known).filter("error_code is null")
    claims = done.select("id", "item_index", "claim.*", "context", *[F.col(f"{end}_some_types").alias(f"{end}_types") for end in ("subject", "object")])
    return _outcome(claims, known).drop("subject_types", "object_types")


def _outcome(df: DataFrame, known: Predicates) -> DataFrame:
    """Claims with subject_types and object_types: outcome and reason, the first rule that fits."""
    p = F.col("predicate")
    table = F.from_json(F.lit(json.dumps({k: {"source": list(s), "target": list(t)} for k, (s, t) in known.relations.items()})), "map<string,struct<source:array<string>,target:array<string>>>")
    spec = table[p]
    fits = lambda types, allowed: F.array_contains(allowed, "*") | F.arrays_overlap(types, allowed)
    word = lambda c, words, default: F.when(F.col(c).isin(*words), F.col(c)).otherwise(default)
    ladder = (
        (F.col("subject_types").isNull(), "REJECTED", "subject_or_object_not_resolved"), (F.col("object_types").isNull(), "CLAIM_ONLY", "subject_or_object_not_resolved"),
        (~p.isin(*known.names), "REJECTED", "claim_predicate_not_registered"), (p.isin(*registry.CLAIM_ONLY_PREDICATES), "CLAIM_ONLY", "predicate_is_claim_only"), (spec.isNull(), "CLAIM_ONLY", "no_relation_predicate_mapping"),
        ((word("polarity", registry.POLARITIES, "positive") != "positive") | (word("modality", registry.MODALITIES, "asserted") != "asserted"), "CONDITIONAL_RELATION", "non_asserted_or_negative_claim"),
        (material_condition(F.col("context")), "CONDITIONAL_RELATION", "material_context_requires_claim_only"),
        (~(fits(F.col("subject_types"), spec["source"]) & fits(F.col("object_types"), spec["target"])), "CLAIM_ONLY", "source_target_types_not_allowed"),
    )
    verdict = None
    for when, outcome, reason in ladder:
        pair = F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason"))
        verdict = F.when(when, pair) if verdict is None else verdict.when(when, pair)
    verdict = verdict.otherwise(F.struct(F.lit("DIRECT_RELATION").alias("outcome"), F.lit("all_direct_relation_requirements_satisfied").alias("reason")))
    return fixed(df, "_v", verdict).select(*df.columns, "_v.outcome", "_v.reason")


# evaluation of drafts


def draft_cases(cases: DataFrame, known: Predicates = DEFAULT) -> DataFrame:
    """Counts of each case (id, source_text, model_draft, expected_entities, expected_claims: JSON): entity_tp, entity_fp, entity_fn, claim_tp, claim_fp, claim_fn, compiled_claims, evidence_hits, ontology_violations, entity_type_violations.

    An entity is right when its folded name is expected with no type that it lacks; a claim when its folded triple is expected.
    """
    lists = lambda c, path: F.coalesce(F.try_variant_get(F.try_parse_json(c), path, "array<variant>"), F.array().cast("array<variant>"))
    c, item = F.col, F.col("item")
    none = F.array().cast("array<string>")
    each = lambda column, path: cases.select("id", "source_text", F.posexplode(lists(column, path)).alias("at", "item"))
    # entities: the last of a name counts; unsupported types are counted and dropped
    given = F.coalesce(_strings(item, "types"), none)
    key = fold(F.coalesce(_get(item, "name"), F.lit("")))
    parts = let(given, lambda g: F.struct(g.alias("given"), F.array_distinct(F.array_compact(F.transform(g, canonical_type))).alias("types"), key.alias("key")))
    drafted = fixed(each("model_draft", "$.entities"), "x", parts).select("id", "at", "x.*")
    index = drafted.filter((F.size("types") > 0) & (c("key") != "")).groupBy("id", "key").agg(F.max_by("types", "at").alias("types"))
    violations = drafted.groupBy("id").agg(F.sum(F.size(F.filter("given", lambda t: canonical_type(t).isNull()))).alias("entity_type_violations"))
    parts = F.struct(key.alias("key"), F.filter(F.transform(F.coalesce(_strings(item, "types"), none), strip), lambda t: t != "").alias("types"))
    wanted = fixed(each("expected_entities", "$"), "x", parts).groupBy("id", "x.key").agg(F.max_by("x.types", "at").alias("expected"))
    both = index.join(wanted, ["id", "key"], "full")
    hit = c("types").isNotNull() & c("expected").isNotNull() & (F.size(F.array_except("expected", "types")) == 0)
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    entity = both.groupBy("id").agg(n(hit, "entity_tp"), n(c("types").isNotNull() & ~F.coalesce(hit, F.lit(False)), "entity_fp"), n(c("expected").isNotNull() & ~F.coalesce(hit, F.lit(False)), "entity_fn"))
    # claims, through the compiler
    text = lambda f: _get(item, f).alias(f)
    parts = F.struct(F.coalesce(_get(item, "subject"), F.lit("")).alias("subject"), F.coalesce(_get(item, "predicate_candidate"), _get(item, "predicate")).alias("predicate"), *map(text, ("object", "claim_type", "polarity", "modality", "temporal_signal", "evidence_quote")), _get(item, "context.note").alias("context_note"), F.lit(None).cast("string").alias("resolution_text"))
    claims = fixed(each("model_draft", "$.claims"), "x", parts).select("id", "source_text", "x.*")
    done = compile_claims(_with_types(claims, index), known=known).filter("status = 'compiled'")
    triple = lambda s, p, o: F.struct(fold(F.coalesce(s, F.lit(""))).alias("s"), p.alias("p"), fold(F.coalesce(o, F.lit(""))).alias("o"))
    quote = fold(F.coalesce(c("evidence_quote"), F.lit("")))
    right = (quote != "") & F.contains(fold(F.coalesce("source_text", F.lit(""))), quote)
    got = done.groupBy("id", triple(c("claim.subject"), c("claim.predicate"), c("claim.object")).alias("t")).agg(F.count("*").alias("got"), n(right, "right"), n(~c("claim.predicate").isin(*known.names), "strange"))
    want = fixed(each("expected_claims", "$"), "t", triple(_get(item, "subject"), normalize_predicate(F.coalesce(_get(item, "predicate"), F.lit(""))), _get(item, "object"))).select("id", "t").distinct().withColumn("want", F.lit(True))
    total = lambda name, out: F.coalesce(F.sum(name), F.lit(0)).alias(out)
    claim = got.join(want, ["id", "t"], "full").groupBy("id").agg(n(c("got").isNotNull() & c("want"), "claim_tp"), n(c("got").isNotNull() & c("want").isNull(), "claim_fp"), n(c("got").isNull() & c("want"), "claim_fn"), total("got", "compiled_claims"), total("right", "evidence_hits"), total("strange", "ontology_violations"))
    out = cases.select("id")
    for part in (entity, claim, violations):  # each has a row a case: sizes guessed from compressed files must not make one a broadcast
        out = out.join(part.hint("merge"), "id", "left")
    return out.na.fill(0)


COUNTS = ("entity_tp", "entity_fp", "entity_fn", "claim_tp", "claim_fp", "claim_fn", "compiled_claims", "evidence_hits", "ontology_violations", "entity_type_violations")


def draft_report(cases: DataFrame, per_case: bool = False, known: Predicates = DEFAULT) -> DataFrame:
    """Precision and recall of entities and claims, evidence accuracy and ontology violation rate, of each case or of the sums over all."""
    counts = draft_cases(cases, known)
    if not per_case:
        counts = counts.agg(F.count("*").alias("cases"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in COUNTS])
    c = F.col
    metrics = {f"{x}_precision": ratio(c(f"{x}_tp"), c(f"{x}_tp") + c(f"{x}_fp")) for x in ("entity", "claim")} | {f"{x}_recall": ratio(c(f"{x}_tp"), c(f"{x}_tp") + c(f"{x}_fn")) for x in ("entity", "claim")}
    metrics |= {"evidence_accuracy": F.when(c("compiled_claims") == 0, 1.0).otherwise(c("evidence_hits") / c("compiled_claims")), "ontology_violation_rate": ratio(c("ontology_violations"), c("compiled_claims"))}
    return counts.select("*", *[m.alias(k) for k, m in metrics.items()])
