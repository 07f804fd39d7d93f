"""Validators: cards, wire rows, proof manifests and JSON schemas, each as columns that name what is wrong."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut

LEVELS = ("L0", "L1", "L2", "L3")
BEHAVIOR_CHARS = (1, 200)


def is_hash(c: Column) -> Column:
    """64 lower-case hex digits; null is none."""
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def hash_or_null(c: Column) -> Column:
    """A root or specification hash as it is, null where it is none."""
    return F.when(is_hash(c), c)


def triplet(wire: Column) -> Column:
    """(root, specHash, level) of a wire row's JSON; null unless it parses, both hashes hold and the level is known."""
    t = F.from_json(wire, "root string, specHash string, level string")
    return F.when(is_hash(t["root"]) & is_hash(t["specHash"]) & t["level"].isin(*LEVELS), t)


def card_errors(behavior: Column, source_hash: Column, schema_version: Column | None = None) -> Column:
    """Names of the broken rules of an intent card, none where it holds."""
    low, high = BEHAVIOR_CHARS
    rules = [("behavior", ~F.coalesce(F.length(behavior).between(low, high), F.lit(False))), ("source_hash", ~is_hash(source_hash))]
    if schema_version is not None:
        rules.append(("schema_version", ~F.coalesce(schema_version == 1, F.lit(False))))
    return named(rules)


def named(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))


def wire_errors(row: dict[str, Column], root: Column) -> Column:
    """Names of the broken rules of a wire row. row: root, spec_hash, impl_base64, manifest, level, created_at, parent, artifacts (a map of
    path to base64 text). ``root`` is the identity made anew from the content."""
    text = lambda c: c.isNull() | (c == "")
    not64 = lambda c: ~F.coalesce(c.rlike("^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.lit(False))
    kinds = F.from_json(row["manifest"], "artifacts array<struct<kind:string,path:string>>")["artifacts"]
    return named(
        [
            ("root", ~is_hash(row["root"])),
            ("spec_hash", ~is_hash(row["spec_hash"])),
            ("impl_empty", text(row["impl_base64"])),
            ("impl_base64", ~text(row["impl_base64"]) & not64(row["impl_base64"])),
            ("created_at", row["created_at"].isNull() | (row["created_at"] < 0)),
            ("parent", row["parent"].isNotNull() & ~is_hash(row["parent"])),
            ("level", ~F.coalesce(row["level"].isin(*LEVELS), F.lit(False))),
            ("level_unsupported", F.coalesce(row["level"].isin(*LEVELS[1:]), F.lit(False))),
            ("manifest", kinds.isNull() | F.exists(F.coalesce(kinds, F.array()), lambda a: a["kind"].isNull() | a["path"].isNull())),
            ("artifacts", row["artifacts"].isNull() | F.exists(F.map_values(F.coalesce(row["artifacts"], F.create_map().cast("map<string,string>"))), not64)),
            ("integrity", ~row["root"].eqNullSafe(root)),
        ]
    )


def proof_level(manifest: Column) -> Column:
    """Level by the first formal proof of a manifest: lean or coq is L3, smt L1, else L0."""
    kinds = F.transform(F.from_json(manifest, "artifacts array<struct<kind:string>>")["artifacts"], lambda a: a["kind"])
    first = F.get(F.filter(kinds, lambda x: x.isin("lean", "coq", "smt")), 0)
    return F.when(first.isin("lean", "coq"), "L3").when(first == "smt", "L1").otherwise("L0")


_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "boolean": "^BOOLEAN", "null": "^VOID", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "integer": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"}
_HANDLED = set(
    "type const enum minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern items prefixItems contains minItems maxItems uniqueItems required "
    "properties patternProperties additionalProperties minProperties maxProperties dependentRequired propertyNames unevaluatedProperties unevaluatedItems allOf anyOf oneOf not if then else $ref $defs "
    "title description default examples $schema $id $comment".split()
)


def schema_valid(doc: Column, schema: dict | bool) -> Column:
    """Whether the JSON text ``doc`` satisfies a schema; null where it isn't JSON.

    The schema is compiled to expressions over a variant, so it runs without Python. $ref names a place in the schema itself and must not
    recur (``schema_checked`` takes such schemas); a keyword that isn't handled raises ValueError. Numbers compare as doubles.
    """
    v = F.try_parse_json(doc)
    return F.when(v.isNotNull(), F.coalesce(_valid(v, schema, schema, ()), F.lit(False)))


#: Keywords under which a subschema holds for all values, as a whole, in part of the cases, and for the value itself.
_CHILD, _CHILDREN, _CHOICES, _CHOICE = ("items", "additionalProperties"), ("properties", "patternProperties"), ("anyOf", "oneOf"), ("not", "if", "then", "else", "contains", "unevaluatedProperties", "unevaluatedItems", "propertyNames")


def _at(top: dict | bool, ref: str) -> dict | bool:
    for key in [k for k in ref.lstrip("#").split("/") if k]:
        top = top[int(key)] if isinstance(top, list) else top[key.replace("~1", "/").replace("~0", "~")]
    return top


def _refs(s: dict | bool) -> set[str]:
    """The places that a schema names, anywhere but in its definitions."""
    if isinstance(s, bool):
        return set()
    out = {s["$ref"]} if "$ref" in s else set()
    subs = [s[k] for k in (*_CHILD, *_CHOICE) if k in s] + [x for k in ("allOf", "prefixItems", *_CHOICES) for x in s.get(k, ())] + [x for k in _CHILDREN for x in s.get(k, {}).values()]
    return out.union(*map(_refs, subs))


def recurring(schema: dict | bool) -> frozenset[str]:
    """The places of a schema that lead back to themselves."""
    after: dict[str, set[str]] = {}
    todo = list(_refs(schema))
    while todo:
        ref = todo.pop()
        if ref not in after:
            after[ref] = _refs(_at(schema, ref))
            todo += after[ref]
    out = set()
    for start in after:
        seen, front = set(), list(after[start])
        while front:
            r = front.pop()
            if r not in seen:
                seen.add(r)
                front += after[r]
        if start in seen:
            out.add(start)
    return frozenset(out)


def schema_checked(rows: DataFrame, id_col: str, doc_col: str, schema: dict | bool) -> DataFrame:
    """(id, valid) for schemas that may recur: null for texts that aren't JSON. Rows that share an id are valid if all are.

    A place that leads back to itself is checked level by level: what stands under it goes to the next round as a value of its own, so rounds are as
    many as documents are deep. It may recur below properties, items and allOf; under anyOf, oneOf, not, if, contains and the unevaluated keywords it raises ValueError.
    """
    names = sorted(recurring(schema))
    v = F.try_parse_json(F.col(doc_col))
    start = cut(rows.select(F.col(id_col).alias("id"), v.alias("node"), F.lit(-1).alias("ref")))
    bad: list[DataFrame] = []
    front, first = start.where("node is not null"), -1

    def checks(ref: int) -> tuple[Column, Column]:
        at = schema if ref < 0 else _at(schema, names[ref])
        node = F.col("node")
        held = F.coalesce(_valid(node, at, schema, (), frozenset(names)), F.lit(False))
        more = [F.transform(x, lambda y: F.struct(y["node"].alias("node"), y["ref"].alias("ref"))) for x in _pending(node, at, schema, (), names)]
        return held, F.flatten(F.array(*more)) if more else F.expr("cast(array() as array<struct<node: variant, ref: int>>)")

    while True:
        held, more = F.lit(True), F.expr("cast(array() as array<struct<node: variant, ref: int>>)")
        for k in range(first, len(names)) if first == 0 else (-1,):
            h, m = checks(k)
            held, more = F.when(F.col("ref") == k, h).otherwise(held), F.when(F.col("ref") == k, m).otherwise(more)
        seen = cut(front.select("id", held.alias("held"), more.alias("more")))
        bad.append(seen.where("not held").select("id"))
        front = cut(seen.select("id", F.explode("more").alias("m")).select("id", "m.node", "m.ref"))
        first = 0
        if front.isEmpty():
            break
    wrong = bad[0]
    for b in bad[1:]:
        wrong = wrong.unionByName(b)
    told = start.groupBy("id").agg(F.bool_or(F.col("node").isNull()).alias("odd"))
    return told.join(wrong.distinct().withColumn("wrong", F.lit(True)), "id", "left").select("id", F.when(~F.col("odd"), F.col("wrong").isNull()).alias("valid"))


def _pending(v: Column, s: dict | bool, top: dict | bool, seen: tuple, names: list[str]) -> list[Column]:
    """Arrays of (node, ref): what recurring places below a value are still to be checked."""
    if isinstance(s, bool) or not any(_leads(r, top, names) for r in _refs(s)):
        return []
    out = []
    go = lambda x, sub, more=(): _pending(x, sub, top, more, names)
    for k in (*_CHOICES, *_CHOICE):
        subs = s.get(k, ()) if k in _CHOICES else (s[k],) if k in s else ()
        if any(_leads(r, top, names) for x in subs for r in _refs(x)):
            raise ValueError(f"a schema that recurs under {k}")
    if "$ref" in s:
        ref = s["$ref"]
        if ref in seen:
            raise ValueError("a schema that recurs without going into a value")
        if ref in names:
            if any(r in names for r in _inplace(_at(top, ref), top, ())):
                raise ValueError("a schema that recurs without going into a value")
            out.append(F.array(F.struct(v.alias("node"), F.lit(names.index(ref)).alias("ref"))))
        else:
            out += go(v, _at(top, ref), (*seen, ref))
    for x in s.get("allOf", ()):
        out += go(v, x, seen)
    array, fields = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$", "map<string,variant>")
    under = lambda values, sub: F.flatten(F.transform(values, lambda x: F.flatten(F.array(*go(x, sub)))))
    some = lambda sub: any(_leads(r, top, names) for r in _refs(sub))
    kind = "cast(array() as array<struct<node: variant, ref: int>>)"
    add = lambda values, sub: out.append(F.coalesce(under(values, sub), F.expr(kind)))
    prefix = s.get("prefixItems", [])
    for i, x in enumerate(prefix):
        if some(x):
            add(F.filter(F.array(F.get(array, F.lit(i))), lambda y: y.isNotNull()), x)
    if "items" in s and some(s["items"]):
        add(F.slice(array, len(prefix) + 1, 1 << 30), s["items"])
    for name, x in s.get("properties", {}).items():
        if some(x):
            add(F.filter(F.array(F.try_element_at(fields, F.lit(name))), lambda y: y.isNotNull()), x)
    for pattern, x in s.get("patternProperties", {}).items():
        if some(x):
            add(F.map_values(F.map_filter(fields, _named(pattern))), x)
    if "additionalProperties" in s and some(s["additionalProperties"]):
        add(F.map_values(F.map_filter(fields, _rest(s))), s["additionalProperties"])
    return out


def _leads(ref: str, top: dict | bool, names: list[str], seen: tuple = ()) -> bool:
    return ref in names or (ref not in seen and any(_leads(r, top, names, (*seen, ref)) for r in _refs(_at(top, ref))))


def _inplace(s: dict | bool, top: dict | bool, seen: tuple) -> set[str]:
    """Places that a schema hands its own value to."""
    if isinstance(s, bool):
        return set()
    out = {s["$ref"]} if "$ref" in s else set()
    if "$ref" in s and s["$ref"] not in seen:
        out |= _inplace(_at(top, s["$ref"]), top, (*seen, s["$ref"]))
    return out.union(*(_inplace(x, top, seen) for x in s.get("allOf", ())))


def _rest(s: dict):
    """Whether a key is named neither by properties nor by a pattern."""
    return lambda k, v: ~k.isin(list(s.get("properties", {}))) & ~_any([k.rlike(p) for p in s.get("patternProperties", {})])


_NO_KEYS, _NO_PLACES = "cast(array() as array<string>)", "cast(array() as array<int>)"


def _evaluated(v: Column, s: dict | bool, top: dict | bool, seen: tuple, open_: frozenset, what: str) -> Column:
    """Of a value that a schema holds for: the keys (what: keys) or places (places) that its keywords, and those of the subschemas that hold, have looked at."""
    none = F.expr(_NO_KEYS if what == "keys" else _NO_PLACES)
    if isinstance(s, bool):
        return none
    go = lambda sub, more=(): _evaluated(v, sub, top, seen + more, open_, what)
    holds = lambda sub: F.coalesce(_valid(v, sub, top, seen, open_), F.lit(False))
    found = []
    if what == "keys":
        keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        if "additionalProperties" in s or "unevaluatedProperties" in s:
            found.append(keys)
        if s.get("properties"):
            found.append(F.array_intersect(keys, F.array(*map(F.lit, s["properties"]))))
        found += [F.filter(keys, _like(p)) for p in s.get("patternProperties", {})]
    else:
        array = F.try_variant_get(v, "$", "array<variant>")
        every = F.transform(array, lambda x, i: i)
        if "items" in s or "unevaluatedItems" in s:
            found.append(every)
        if "prefixItems" in s:
            found.append(F.slice(every, 1, len(s["prefixItems"])))
        if "contains" in s:
            told = F.transform(array, lambda x: F.coalesce(_valid(x, s["contains"], top, (), open_), F.lit(False)))
            found.append(F.filter(every, lambda i: F.get(told, i)))
    if "$ref" in s and s["$ref"] not in open_:
        if s["$ref"] in seen:
            raise ValueError("a schema that recurs")
        found.append(go(_at(top, s["$ref"]), (s["$ref"],)))
    found += [go(x) for x in s.get("allOf", ())]
    found += [F.when(holds(x), go(x)) for k in _CHOICES for x in s.get(k, ())]
    if "if" in s:
        found.append(F.when(holds(s["if"]), F.array_union(go(s["if"]), go(s.get("then", True)))).otherwise(go(s.get("else", True))))
    out = none
    for x in found:
        out = F.array_union(out, F.coalesce(x, none))
    return out


def _valid(v: Column, s: dict | bool, top: dict | bool, seen: tuple, open_: frozenset = frozenset()) -> Column:
    """Whether a schema holds for a value; places in ``open_`` are checked elsewhere and hold here."""
    if isinstance(s, bool):
        return F.lit(s)
    if unknown := set(s) - _HANDLED:
        raise ValueError(f"schema keywords that aren't handled: {sorted(unknown)}")
    kind = F.schema_of_variant(v)
    get = lambda t: F.try_variant_get(v, "$", t)
    is_ = lambda name: kind.rlike(_KINDS[name])
    number, text = get("double"), get("string")
    go = lambda x, sub, more=(): _valid(x, sub, top, seen + more, open_)
    checks: list[Column] = []

    def of(name: str, ok: Column) -> None:
        checks.append(~is_(name) | F.coalesce(ok, F.lit(False)))

    def same(x) -> Column:
        return F.coalesce(F.to_json(v) == F.to_json(F.parse_json(F.lit(_json(x)))), F.lit(False))

    if "$ref" in s:
        ref = s["$ref"]
        if ref not in open_:
            if ref in seen:
                raise ValueError("a schema that recurs")
            checks.append(go(v, _at(top, ref), (ref,)))
    if "type" in s:
        names = [s["type"]] if isinstance(s["type"], str) else s["type"]
        each = [is_(n) & (number == F.floor(number)) if n == "integer" else is_(n) for n in names]
        checks.append(_any(each))
    if "const" in s:
        checks.append(same(s["const"]))
    if "enum" in s:
        checks.append(_any([same(x) for x in s["enum"]]))
    for key, ok in (("minimum", lambda x: number >= x), ("maximum", lambda x: number <= x), ("exclusiveMinimum", lambda x: number > x), ("exclusiveMaximum", lambda x: number < x), ("multipleOf", lambda x: F.abs(number / x - F.round(number / x)) < 1e-9)):
        if key in s:
            of("number", ok(float(s[key])))
    for key, ok in (("minLength", lambda x: F.length(text) >= x), ("maxLength", lambda x: F.length(text) <= x), ("pattern", lambda x: text.rlike(x))):
        if key in s:
            of("string", ok(s[key]))
    array = get("array<variant>")
    prefix = s.get("prefixItems", [])
    for i, sub in enumerate(prefix):
        of("array", (F.size(array) <= i) | F.coalesce(go(F.get(array, F.lit(i)), sub), F.lit(False)))
    if "items" in s:
        of("array", F.forall(F.slice(array, len(prefix) + 1, 1 << 30) if prefix else array, lambda x: F.coalesce(go(x, s["items"]), F.lit(False))))
    if "contains" in s:
        of("array", F.exists(array, lambda x: F.coalesce(go(x, s["contains"]), F.lit(False))))
    if "minItems" in s:
        of("array", F.size(array) >= s["minItems"])
    if "maxItems" in s:
        of("array", F.size(array) <= s["maxItems"])
    if s.get("uniqueItems"):
        flat = F.transform(array, lambda x: F.to_json(x))
        of("array", F.size(F.array_distinct(flat)) == F.size(flat))
    fields = get("map<string,variant>")
    keys = F.map_keys(fields)
    for name in s.get("required", ()):
        of("object", F.array_contains(keys, name))
    for name, sub in s.get("properties", {}).items():
        of("object", ~F.array_contains(keys, name) | F.coalesce(go(F.try_element_at(fields, F.lit(name)), sub), F.lit(False)))
    for pattern, sub in s.get("patternProperties", {}).items():
        of("object", F.forall(F.map_values(F.map_filter(fields, _named(pattern))), _under(go, sub)))
    if "additionalProperties" in s:
        rest = F.map_filter(fields, _rest(s))
        of("object", F.forall(F.map_values(rest), lambda x: F.coalesce(go(x, s["additionalProperties"]), F.lit(False))))
    if "minProperties" in s:
        of("object", F.size(keys) >= s["minProperties"])
    if "maxProperties" in s:
        of("object", F.size(keys) <= s["maxProperties"])
    for name, more in s.get("dependentRequired", {}).items():
        of("object", ~F.array_contains(keys, name) | _all([F.array_contains(keys, x) for x in more]))
    if "propertyNames" in s:
        sub = s["propertyNames"]
        if set(sub) - {"pattern", "minLength", "maxLength"}:
            raise ValueError("propertyNames knows pattern, minLength and maxLength")
        of("object", F.forall(keys, lambda k: k.rlike(sub.get("pattern", "")) & F.length(k).between(sub.get("minLength", 0), sub.get("maxLength", 1 << 30))))
    if "allOf" in s:
        checks.append(_all([go(v, x) for x in s["allOf"]]))
    if "anyOf" in s:
        checks.append(_any([go(v, x) for x in s["anyOf"]]))
    if "oneOf" in s:
        checks.append(sum((F.coalesce(go(v, x), F.lit(False)).cast("int") for x in s["oneOf"]), F.lit(0)) == 1)
    if "not" in s:
        checks.append(~F.coalesce(go(v, s["not"]), F.lit(False)))
    if "if" in s:
        holds = F.coalesce(go(v, s["if"]), F.lit(False))
        checks.append(F.when(holds, go(v, s.get("then", True))).otherwise(go(v, s.get("else", True))))
    if "unevaluatedProperties" in s:
        seen_keys = _evaluated(v, {k: x for k, x in s.items() if k != "unevaluatedProperties"}, top, seen, open_, "keys")
        of("object", F.forall(F.map_values(F.map_filter(fields, lambda k, _: ~F.array_contains(seen_keys, k))), _under(go, s["unevaluatedProperties"])))
    if "unevaluatedItems" in s:
        seen_places = _evaluated(v, {k: x for k, x in s.items() if k != "unevaluatedItems"}, top, seen, open_, "places")
        of("array", F.forall(F.filter(array, lambda x, i: ~F.array_contains(seen_places, i)), _under(go, s["unevaluatedItems"])))
    return _all(checks)


def _named(pattern: str):
    return lambda k, v: k.rlike(pattern)


def _like(pattern: str):
    return lambda k: k.rlike(pattern)


def _under(go, sub):
    return lambda x: F.coalesce(go(x, sub), F.lit(False))


def _json(x) -> str:
    import json

    return json.dumps(x)


def _any(found: list[Column]) -> Column:
    out = F.lit(False)
    for x in found:
        out = out | F.coalesce(x, F.lit(False))
    return out


def _all(found: list[Column]) -> Column:
    out = F.lit(True)
    for x in found:
        out = out & F.coalesce(x, F.lit(False))
    return out


def allowed(name: Column, patterns: list[str]) -> Column:
    """Whether any pattern names it, case aside; an invalid pattern counts for nothing."""
    good = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        good.append(p)
    return _any([name.rlike(f"(?i){p}") for p in good])
