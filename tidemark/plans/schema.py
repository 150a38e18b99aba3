"""The schema language: strict parsing, validation, compilation, diffs and versions."""

from __future__ import annotations

import hashlib
import json
import re
from copy import deepcopy
from dataclasses import dataclass, field

import yaml

from tidemark.functions import expressions as ex
from tidemark.functions.decay import duration_seconds
from tidemark.sources.ingest import Attribute, EntitySpec

# The words of the language.
ATTRIBUTE_TYPES = ["categorical", "string", "float", "int", "bool", "timestamp", "set", "vector", "ref", "geo"]
KINDS = ["positive", "negative", "explicit", "exposure", "conversion"]
METRICS = ["jaccard", "equals", "log_ratio", "closeness", "cosine"]
NORMALISERS = ["minmax", "rank", "zscore", "none"]
SEEDS = ["user", "item", "items", "session", "users", "none"]
SOURCES = ["item_neighbors", "co_occurrence", "user_neighbors", "factors", "popular", "fresh", "trend", "unexposed", "sequence", "mutuals", "provided"]
RUN_SOURCES = SOURCES[:6]
TRANSFORMS = ["identity", "log1p", "sqrt", "clamp"]
DEDUPE = ["none", "per_item", "per_item_per_day"]
DERIVED = ["hour", "weekday", "month"]
OPERATORS = ["equals", "in", "contains", "gt", "gte", "lt", "lte", "within_km"]
COMMON_SIGNAL_KEYS = ["type", "for", "from", "default", "normalise", "cap", "transform", "explain"]
SIGNALS = {
    "item_neighbors": ["terms"],
    "co_occurrence": ["of", "group_by", "order", "window", "min_support", "measure"],
    "user_neighbors": ["of", "min_neighbors"],
    "attribute_target": ["on", "target"],
    "proximity": ["on", "to", "half_distance"],
    "global_count": ["window", "of"],
    "low_exposure": ["of"],
    "age_decay": ["on", "half_life"],
    "context_match": ["on", "against"],
    "provided": ["name"],
    "embedding": ["factors", "regularization", "alpha", "iterations", "of"],
    "own_history": ["of"],
    "attribute_match": ["on", "against"],
    "diversity_rerank": ["on"],
    "trend": ["on", "window", "baseline", "against", "of", "count", "min", "ratio"],
    "sequence": ["of", "gap"],
    "mutual_connections": ["via"],
    "attribute_value": ["on"],
    "formula": ["expr"],
    "satiation": ["of", "by", "level"],
    "recurrence": [],
}
RUN_SIGNALS = ["item_neighbors", "co_occurrence", "user_neighbors", "attribute_target", "proximity", "global_count", "low_exposure", "age_decay", "context_match", "provided", "embedding"]
SECTIONS = {
    "": ["version", "meta", "texts", "entities", "interactions", "context", "similarity", "signals", "constraints", "rules", "knobs", "presets", "recommenders", "metrics", "experiments", "holdout", "privacy", "evaluation", "feedback", "recurrence", "recommendable"],
    "entity": ["key", "parent", "lifecycle", "attributes"],
    "attribute": ["type", "of", "entity", "dim", "range", "optional", "computed", "vocab", "sensitive", "label"],
    "interaction": ["kind", "weight", "value", "transform", "half_life", "target", "locked", "dedupe", "retention", "session", "fulfils", "fields", "label"],
    "context": ["type", "of", "optional", "values", "range", "derive", "entity", "label"],
    "term": ["id", "on", "via", "metric", "weight", "k", "from", "index", "locked", "min_shared", "of", "damp_popular"],
    "constraint": ["id", "for", "require", "exclude", "label"],
    "condition": ["attribute", "interacted", "in_seed", "equals", "in", "contains", "gt", "gte", "lt", "lte", "within_km", "of", "count_gte", "within", "when"],
    "knob": ["id", "kind", "label", "group", "help", "range", "default", "options", "scope", "maps", "depends_on", "steps"],
    "recommender": ["label", "for", "seed", "seed_aggregate", "blend_user", "candidates", "signals", "weights", "constraints", "rules", "knobs", "limit", "fallback", "rerank", "mix", "group", "reciprocal"],
    "source": ["source", "signal", "cap"],
    "experiment": ["recommender", "status", "unit", "layer", "traffic", "audience", "method", "variants", "goal", "guardrails", "stop", "gate", "on_finish"],
}
NAME = re.compile(r"[a-z][a-z0-9_]*")
#: Candidates of a request, items of a source and of an answer.
DEFAULT_LIMIT, MAX_LIMIT = 30, 200


@dataclass(frozen=True)
class Issue:
    """One thing wrong, and where."""

    path: str
    message: str

    def __str__(self) -> str:
        return f"{self.path}: {self.message}"


class SchemaError(ValueError):
    """The schema is not valid; ``issues`` has all of it."""

    def __init__(self, issues: list[Issue]):
        super().__init__("; ".join(map(str, issues)))
        self.issues = issues


class _Loader(yaml.SafeLoader):
    """YAML without timestamps and with repeated keys as errors."""


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict:
    seen = [loader.construct_object(k) for k, _ in node.value]
    for k in seen:
        if seen.count(k) > 1:
            raise SchemaError([Issue(str(k), "repeated key")])
    return {loader.construct_object(k, deep=True): loader.construct_object(v, deep=True) for k, v in node.value}


_Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)
_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
_Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile("true|false"), list("tf"))  # so that a key may be "on"


def _strict(value: object, kind: str, path: str, out: list[Issue]) -> None:
    if value is None:
        return
    if not isinstance(value, dict):
        out.append(Issue(path or kind, "must be a mapping"))
        return
    for key in value:
        if key not in SECTIONS[kind]:
            out.append(Issue(f"{path}.{key}".lstrip("."), "unknown key"))


def parse(text: str) -> dict:
    """The document of a schema; unknown keys are errors."""
    try:
        doc = yaml.load(text, Loader=_Loader)
    except yaml.YAMLError as e:
        raise SchemaError([Issue("", f"not YAML: {e}")]) from e
    if not isinstance(doc, dict):
        raise SchemaError([Issue("", "must be a mapping")])
    out: list[Issue] = []
    _strict(doc, "", "", out)
    for name, entity in (doc.get("entities") or {}).items():
        _strict(entity, "entity", f"entities.{name}", out)
        for attr, spec in ((entity or {}).get("attributes") or {}).items():
            _strict(spec, "attribute", f"entities.{name}.attributes.{attr}", out)
    for section, kind in (("interactions", "interaction"), ("context", "context"), ("recommenders", "recommender"), ("experiments", "experiment")):
        for name, spec in (doc.get(section) or {}).items():
            _strict(spec, kind, f"{section}.{name}", out)
    for name, terms in (doc.get("similarity") or {}).items():
        if name != "cross":
            for k, t in enumerate(terms or []):
                _strict(t, "term", f"similarity.{name}[{k}]", out)
    for k, c in enumerate(doc.get("constraints") or []):
        _strict(c, "constraint", f"constraints[{k}]", out)
        for side in ("require", "exclude"):
            _strict((c or {}).get(side), "condition", f"constraints[{k}].{side}", out)
    for k, knob in enumerate(doc.get("knobs") or []):
        _strict(knob, "knob", f"knobs[{k}]", out)
    if out:
        raise SchemaError(out)
    return doc


def listed(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def ranked_type(doc: dict) -> str | None:
    """What is recommended: as named, or the only entity type besides users."""
    if doc.get("recommendable"):
        return listed(doc["recommendable"])[0]
    others = [e for e in doc.get("entities") or {} if e != "user"]
    return others[0] if len(others) == 1 else None


def interaction_kind(spec: dict) -> str:
    return spec.get("kind") or ("negative" if (spec.get("weight") or 0) < 0 else "positive")


def counts_as_positive(spec: dict) -> bool:
    kind = interaction_kind(spec)
    return kind == "explicit" or kind in ("positive", "conversion") and (spec.get("weight") or 0) > 0


class Validator:
    """Collects every issue of a document, in the document's order."""

    def __init__(self, doc: dict):
        self.doc, self.issues = doc, []
        self.entities = doc.get("entities") or {}
        self.interactions = doc.get("interactions") or {}
        self.signals = doc.get("signals") or {}
        self.recommenders = doc.get("recommenders") or {}

    def add(self, path: str, message: str) -> None:
        self.issues.append(Issue(path, message))

    def need(self, good: bool, path: str, message: str) -> None:
        if not good:
            self.add(path, message)

    def name(self, value: str, path: str) -> None:
        self.need(isinstance(value, str) and bool(NAME.fullmatch(value)), path, "must be lower case letters, digits and _")

    def duration(self, value, path: str) -> None:
        try:
            duration_seconds(str(value))
        except ValueError:
            self.add(path, "not a duration")

    def numeric(self, source, variable: str, path: str) -> None:
        try:
            ex.check_numeric(ex.parse(str(source)), variable)
        except ex.ExpressionError as e:
            self.add(path, str(e))

    def attributes(self, entity: str) -> dict:
        return (self.entities.get(entity) or {}).get("attributes") or {}

    def run(self) -> list[Issue]:
        self.need(isinstance(self.doc.get("version"), int) and self.doc.get("version", 0) >= 1, "version", "must be 1 or more")
        self.need("user" in self.entities, "entities", "an entity named user is needed")
        self.need(ranked_type(self.doc) is not None, "recommendable", "must be named as there is more than one entity")
        for part in (self._entities, self._interactions, self._context, self._similarity, self._signals, self._constraints, self._rules, self._knobs, self._presets, self._recommenders, self._metrics, self._experiments, self._holdout, self._evaluation):
            part()
        return self.issues

    def _entities(self) -> None:
        vocab: dict[str, str] = {}
        for name, entity in self.entities.items():
            at, entity = f"entities.{name}", entity or {}
            self.name(name, at)
            self.need(name != "cross", at, "the name is reserved")
            self.need(bool(entity.get("key")), f"{at}.key", "is needed")
            attrs = entity.get("attributes") or {}
            for attr, spec in attrs.items():
                self._attribute(f"{at}.attributes.{attr}", attr, spec or {}, vocab)
            parent = entity.get("parent")
            if parent is not None:
                self.need((attrs.get(parent) or {}).get("type") == "ref" and attrs[parent].get("entity") == name, f"{at}.parent", "must be a ref to the same entity")
            life = entity.get("lifecycle") or {}
            for key in ("created", "expires"):
                if key in life:
                    self.need((attrs.get(life[key]) or {}).get("type") == "timestamp", f"{at}.lifecycle.{key}", "must name a timestamp")
            if "active" in life:
                self.need(bool((life["active"] or {}).get("in")), f"{at}.lifecycle.active", "needs values")
            self._computed(at, attrs)

    def _attribute(self, at: str, name: str, spec: dict, vocab: dict[str, str]) -> None:
        kind = spec.get("type")
        self.name(name, at)
        self.need(kind in ATTRIBUTE_TYPES, f"{at}.type", "unknown type")
        if kind == "ref":
            self.need(spec.get("entity") in self.entities, f"{at}.entity", "must name an entity")
        if kind == "set":
            self.need(spec.get("of", "string") == "string", f"{at}.of", "a set is of string")
        self.need(isinstance(spec.get("dim", 0), int) and spec.get("dim", 0) >= 0, f"{at}.dim", "must be 0 or more")
        if "range" in spec:
            r = spec["range"]
            self.need(kind in ("float", "int"), f"{at}.range", "is for numbers")
            self.need(isinstance(r, list) and len(r) == 2 and r[0] < r[1], f"{at}.range", "must be [low, high]")
        if spec.get("computed"):
            self.need(kind in ("int", "float", "string", "categorical", "bool"), f"{at}.computed", "not for this type")
            self.need(not spec.get("optional"), f"{at}.optional", "a computed attribute is not optional")
        if spec.get("vocab"):
            held = vocab.setdefault(spec["vocab"], kind)
            self.need(held == kind, f"{at}.vocab", "shared by attributes of different types")

    def _computed(self, at: str, attrs: dict) -> None:
        try:
            computed_order({n: Attribute(a.get("type", ""), computed=a.get("computed")) for n, a in attrs.items() if a})
        except (ValueError, ex.ExpressionError) as e:
            self.add(f"{at}.attributes", str(e))

    def _interactions(self) -> None:
        self.need(bool(self.interactions), "interactions", "at least one is needed")
        for name, spec in self.interactions.items():
            at, spec = f"interactions.{name}", spec or {}
            weight, kind = spec.get("weight"), interaction_kind(spec)
            self.name(name, at)
            self.need(kind in KINDS, f"{at}.kind", "unknown kind")
            self.need(weight is None or isinstance(weight, (int, float)) and abs(weight) < float("inf"), f"{at}.weight", "must be a finite number")
            if "half_life" in spec:
                self.duration(spec["half_life"], f"{at}.half_life")
            if "target" in spec:
                self.need(spec["target"] in self.entities, f"{at}.target", "must name an entity")
            if "transform" in spec:
                self.need("value" in spec, f"{at}.transform", "needs a value")
                if spec["transform"] not in TRANSFORMS:
                    self.numeric(spec["transform"], "v", f"{at}.transform")
            if kind == "exposure":
                for key in ("weight", "value", "fulfils", "half_life"):
                    self.need(key not in spec, f"{at}.{key}", "an exposure has none")
            if isinstance(weight, (int, float)):
                self.need(kind != "negative" or weight <= 0, f"{at}.weight", "a negative interaction weighs 0 or less")
                self.need(kind not in ("positive", "conversion") or weight >= 0, f"{at}.weight", "a positive interaction weighs 0 or more")
            self.need(spec.get("dedupe", "none") in DEDUPE, f"{at}.dedupe", "unknown dedupe")
            for f, field_spec in (spec.get("fields") or {}).items():
                self.need((field_spec or {}).get("type") in ("categorical", "string", "int", "float", "bool", "timestamp", "ref"), f"{at}.fields.{f}", "unknown type")

    def _context(self) -> None:
        for name, spec in (self.doc.get("context") or {}).items():
            at, spec = f"context.{name}", spec or {}
            if "derive" in spec:
                self.need(spec["derive"] in DERIVED and spec.get("type", "int") == "int", f"{at}.derive", "derives an int hour, weekday or month")
            else:
                self.need(spec.get("type") in ATTRIBUTE_TYPES, f"{at}.type", "unknown type")
            if "values" in spec:
                self.need(spec.get("type") == "categorical", f"{at}.values", "is for categorical values")

    def _similarity(self) -> None:
        for entity, terms in (self.doc.get("similarity") or {}).items():
            if entity == "cross":
                continue
            at = f"similarity.{entity}"
            self.need(entity in self.entities, at, "must name an entity")
            seen = set()
            for k, t in enumerate(terms or []):
                here, t = f"{at}[{k}]", t or {}
                self.need(t.get("metric") in METRICS, f"{here}.metric", "unknown metric")
                self.need(("on" in t) != ("via" in t), here, "needs one of on and via")
                if "on" in t:
                    for a in listed(t["on"]):
                        kind = (self.attributes(entity).get(a) or {}).get("type")
                        self.need(kind is not None, f"{here}.on", f"unknown attribute {a}")
                        self.need(kind != "geo", f"{here}.on", "a place has no metric")
                        self.need(t.get("index") != "hnsw" or kind == "vector", f"{here}.index", "hnsw is for vectors")
                    self.need((t.get("weight") or 0) > 0, f"{here}.weight", "must be above 0")
                    if t.get("metric") == "closeness":
                        kinds = [(self.attributes(entity).get(a) or {}).get("type") for a in listed(t["on"])]
                        self.need(len(kinds) == 1 and kinds[0] in ("int", "float"), f"{here}.on", "closeness takes one number")
                    key = t.get("id", listed(t["on"])[0])
                    self.need(key not in seen, f"{here}.id", "repeated")
                    seen.add(key)

    def _signals(self) -> None:
        for name, s in self.signals.items():
            at, s = f"signals.{name}", s or {}
            kind = s.get("type")
            self.name(name, at)
            if kind not in SIGNALS:
                self.add(f"{at}.type", "unknown signal type")
                continue
            for key in s:
                self.need(key in COMMON_SIGNAL_KEYS or key in SIGNALS[kind], f"{at}.{key}", f"not a parameter of {kind}")
            self.need(s.get("normalise", "minmax") in NORMALISERS, f"{at}.normalise", "unknown normaliser")
            self.need("cap" not in s or 0 < s["cap"] <= 1, f"{at}.cap", "must be above 0, at most 1")
            self.need(isinstance(s.get("default", 0), (int, float)), f"{at}.default", "must be a number")
            for i in listed(s.get("of")):
                self.need(i in self.interactions, f"{at}.of", f"unknown interaction {i}")
            for key in ("window", "half_life", "baseline", "gap"):
                if key in s:
                    self.duration(s[key], f"{at}.{key}")
            if kind == "co_occurrence":
                self.need(s.get("measure", "lift") in ("lift", "cosine", "count"), f"{at}.measure", "must be lift, cosine or count")
            if kind == "embedding":
                self.need(1 <= s.get("factors", 32) <= 256, f"{at}.factors", "must be 1 to 256")
                self.need(1 <= s.get("iterations", 15) <= 200, f"{at}.iterations", "must be 1 to 200")
                self.need(s.get("regularization", 0.1) > 0 and s.get("alpha", 10) > 0, at, "regularization and alpha must be above 0")
            for e in listed(s.get("for")):
                self.need(e in self.entities, f"{at}.for", f"unknown entity {e}")

    def _constraints(self) -> None:
        ranked = ranked_type(self.doc)
        for k, c in enumerate(self.doc.get("constraints") or []):
            at = f"constraints[{k}]"
            self.need(bool(c.get("id")), f"{at}.id", "is needed")
            self.need(("require" in c) != ("exclude" in c), at, "needs one of require and exclude")
            cond = c.get("require") or c.get("exclude") or {}
            about = [x for x in ("attribute", "interacted", "in_seed") if x in cond]
            self.need(len(about) == 1, at, "needs one of attribute, interacted and in_seed")
            used = [o for o in OPERATORS if o in cond]
            if "attribute" in cond:
                self.need(len(used) == 1, at, "needs one operator")
                for entity in listed(c.get("for")) or [ranked]:
                    self.need(cond["attribute"] in self.attributes(entity), f"{at}.attribute", f"unknown attribute {cond['attribute']}")
                if "within_km" in cond:
                    self.need(cond["within_km"] > 0 and "of" in cond, f"{at}.within_km", "must be above 0 and needs of")
            if "interacted" in cond:
                for i in listed(cond["interacted"]):
                    self.need(i in self.interactions, f"{at}.interacted", f"unknown interaction {i}")
            else:
                self.need("count_gte" not in cond and "within" not in cond, at, "count_gte and within go with interacted")
            if "in_seed" in cond:
                self.need(set(cond) <= {"in_seed", "when"}, at, "in_seed stands alone")
            if "within" in cond:
                self.duration(cond["within"], f"{at}.within")
            if "when" in cond:
                self._guard(cond["when"], f"{at}.when")

    def _guard(self, source, at: str) -> None:
        try:
            ex.parse(str(source))
        except ex.ExpressionError as e:
            self.add(at, str(e))

    def _rules(self) -> None:
        actions = ["quota", "place", "boost", "bury", "cap", "pin"]
        for k, r in enumerate(self.doc.get("rules") or []):
            at = f"rules[{k}]"
            used = [a for a in actions if a in r]
            self.need(len(used) == 1, at, "needs one action")
            q = r.get("quota") or {}
            if "quota" in r and "max" in q:
                self.need(q["max"] >= 1 and q.get("per", 0) >= q["max"], f"{at}.quota", "max must be 1 or more and per at least max")
            if "quota" in r and "min_share" in q:
                self.need(0 < q["min_share"] <= 1, f"{at}.quota.min_share", "must be above 0, at most 1")
            if "boost" in r:
                self.need(r["boost"] > 0, f"{at}.boost", "must be above 0")
            if "when" in r:
                self._guard(r["when"], f"{at}.when")

    def _knobs(self) -> None:
        seen = set()
        for k, knob in enumerate(self.doc.get("knobs") or []):
            at = f"knobs[{k}]"
            self.need(bool(knob.get("id")) and knob.get("id") not in seen, f"{at}.id", "must be there and unique")
            seen.add(knob.get("id"))
            self.need(bool(knob.get("label")), f"{at}.label", "is needed")
            low, high = knob_range(knob)
            self.need(low < high, f"{at}.range", "must be [low, high]")
            if "default" in knob:
                self.need(low <= knob["default"] <= high, f"{at}.default", "outside the range")
            self.need(bool(knob.get("maps")), f"{at}.maps", "is needed")
            for target, source in (knob.get("maps") or {}).items():
                self.numeric(source, "x", f"{at}.maps.{target}")
                known = target in self.signals or re.match(r"(signals|similarity|recommenders|interactions|constraint|rules)\.", str(target))
                self.need(bool(known), f"{at}.maps.{target}", "unknown target")
            for r in listed(knob.get("scope")):
                self.need(r in self.recommenders, f"{at}.scope", f"unknown recommender {r}")

    def _presets(self) -> None:
        knobs = {k.get("id"): k for k in self.doc.get("knobs") or []}
        for name, values in (self.doc.get("presets") or {}).items():
            for knob, value in (values or {}).items():
                at = f"presets.{name}.{knob}"
                if knob not in knobs:
                    self.add(at, "unknown knob")
                    continue
                low, high = knob_range(knobs[knob])
                self.need(isinstance(value, (int, float)) and low <= value <= high, at, "outside the range")

    def _recommenders(self) -> None:
        constraints = {c.get("id") for c in self.doc.get("constraints") or []}
        rules = {r.get("id") for r in self.doc.get("rules") or []}
        knobs = {k.get("id") for k in self.doc.get("knobs") or []}
        for name, r in self.recommenders.items():
            at = f"recommenders.{name}"
            self.need(bool(r.get("for")), f"{at}.for", "is needed")
            for e in listed(r.get("for")):
                self.need(e in self.entities, f"{at}.for", f"unknown entity {e}")
            seed = r.get("seed", "none")
            self.need(seed in SEEDS, f"{at}.seed", "unknown seed")
            self.need("seed_aggregate" not in r or seed in ("items", "session"), f"{at}.seed_aggregate", "is for seeds of items")
            if "blend_user" in r:
                self.need(seed in ("item", "items", "session") and 0 <= r["blend_user"] <= 1, f"{at}.blend_user", "is for item seeds, 0 to 1")
            for key, known in (("signals", set(self.signals)), ("constraints", constraints), ("rules", rules), ("knobs", knobs)):
                for x in listed(r.get(key)):
                    self.need(x in known, f"{at}.{key}", f"unknown {x}")
            for k, s in enumerate(listed(r.get("candidates"))):
                self.need(s.get("source") in SOURCES, f"{at}.candidates[{k}].source", "unknown source")
                if s.get("source") in ("co_occurrence", "factors"):
                    self.need(s.get("signal") in self.signals, f"{at}.candidates[{k}].signal", "is needed")
            limit = r.get("limit") or {}
            self.need(1 <= limit.get("default", 1) <= limit.get("max", MAX_LIMIT), f"{at}.limit", "default must be 1 to max")
            for s, source in (r.get("weights") or {}).items():
                self.need(s in self.signals, f"{at}.weights.{s}", "unknown signal")
                self._guard(source, f"{at}.weights.{s}")
            self._fallback(name)

    def _fallback(self, name: str) -> None:
        seen, at = [name], name
        while True:
            after = [f.get("use") for f in (self.recommenders.get(at) or {}).get("fallback") or []]
            for use in after:
                self.need(use in self.recommenders, f"recommenders.{at}.fallback", f"unknown recommender {use}")
            if not after or after[0] not in self.recommenders:
                return
            if after[0] in seen:
                self.add(f"recommenders.{name}.fallback", "falls back to itself")
                return
            at = after[0]
            seen.append(at)

    def _metrics(self) -> None:
        for name, m in (self.doc.get("metrics") or {}).items():
            at = f"metrics.{name}"
            forms = [f for f in ("ratio", "mean", "returning_users", "list", "system") if f in m]
            self.need(len(forms) == 1, at, "needs one form")
            if "ratio" in m:
                self.need(len(m["ratio"]) == 2 and all(i in self.interactions for i in m["ratio"]), f"{at}.ratio", "must be two interactions")
                if len(m["ratio"]) == 2 and m["ratio"][1] in self.interactions:
                    self.need(interaction_kind(self.interactions[m["ratio"][1]] or {}) == "exposure", f"{at}.ratio", "is per exposure")
            if "quantile" in m:
                self.need(0 < m["quantile"] < 1, f"{at}.quantile", "must be between 0 and 1")

    def _experiments(self) -> None:
        layers: dict[str, float] = {}
        for name, e in (self.doc.get("experiments") or {}).items():
            at = f"experiments.{name}"
            self.need(e.get("recommender") in self.recommenders, f"{at}.recommender", "unknown recommender")
            self.need(e.get("status", "draft") in ("draft", "running", "paused", "finished"), f"{at}.status", "unknown status")
            self.need(e.get("unit", "user") in ("user", "request", "session"), f"{at}.unit", "unknown unit")
            traffic = e.get("traffic", 1)
            self.need(0 < traffic <= 1, f"{at}.traffic", "must be above 0, at most 1")
            if e.get("status") == "running":
                layer = e.get("layer", name)
                layers[layer] = layers.get(layer, 0) + traffic
                self.need(layers[layer] <= 1 + 1e-9, f"{at}.traffic", "the layer has more than all traffic")
            variants = e.get("variants") or {}
            self.need("control" in variants, f"{at}.variants", "control is needed")
            self.need(not (variants.get("control") or {}).get("set"), f"{at}.variants.control", "control changes nothing")
            self.need(abs(sum((v or {}).get("share", 0) for v in variants.values()) - 1) < 1e-6, f"{at}.variants", "shares must add up to 1")
            for v, spec in variants.items():
                for path in (spec or {}).get("set") or {}:
                    self.need(tier(path) >= 2, f"{at}.variants.{v}.set", f"{path} may not be changed by an experiment")

    def _holdout(self) -> None:
        h = self.doc.get("holdout")
        if h:
            self.need(0 < h.get("share", 0) <= 0.5, "holdout.share", "must be above 0, at most 0.5")
            r = self.recommenders.get(h.get("recommender")) or {}
            self.need(r.get("seed") == "none", "holdout.recommender", "must have no seed")

    def _evaluation(self) -> None:
        e = self.doc.get("evaluation")
        if e:
            self.need((e.get("split") or {}).get("by", e.get("split")) in ("time", "random"), "evaluation.split", "must be time or random")
            self.need(e.get("k", 1) >= 1, "evaluation.k", "must be 1 or more")


def validate(doc: dict) -> list[Issue]:
    return Validator(doc).run()


def knob_range(knob: dict) -> tuple[float, float]:
    """Effective range: a toggle is 0 to 1, a choice spans its options."""
    if knob.get("kind") == "choice":
        values = [o["value"] if isinstance(o, dict) else o for o in knob.get("options") or [0, 1]]
        return float(min(values)), float(max(values))
    low, high = knob.get("range") or [0, 1]
    return float(low), float(high)


def computed_order(attrs: dict[str, Attribute]) -> list[str]:
    """Computed attributes so that each comes after those it reads."""
    reads = {n: {x.removeprefix("$item.") for x in ex.parse(a.computed).names()} & set(attrs) for n, a in attrs.items() if a.computed}
    out: list[str] = []
    while len(out) < len(reads):
        ready = [n for n in reads if n not in out and not (reads[n] & set(reads)) - set(out)]
        if not ready:
            raise ValueError(f"computed attributes read each other: {sorted(set(reads) - set(out))}")
        out += sorted(ready)
    return out


def tier(path: str) -> int:
    """Who may change what a path names: 0 stored data, 1 what is learned, 2 what is
    shown, 3 scoring."""
    if re.match(r"(entities|interactions\.[^.]+\.(value|target|fields|kind)|version|context)(\.|$)", path):
        return 0
    if re.match(r"(similarity\.[^.]+\.[^.]+\.(metric|on)|signals\.[^.]+\.(type|of|group_by|factors))(\.|$)", path):
        return 1
    if re.match(r"(constraints|privacy|holdout|recommenders\.[^.]+\.(for|seed|candidates|constraints|limit))(\.|$)", path):
        return 2
    return 3


def patch(doc: dict, changes: dict[str, object]) -> dict:
    """A copy with dotted paths set; items of lists go by id, null deletes."""
    out = deepcopy(doc)
    for path, value in changes.items():
        keys, at = path.split("."), out
        for key in keys[:-1]:
            if isinstance(at, list):
                at = next((x for x in at if isinstance(x, dict) and (x.get("id") == key or x.get("on") == key)), None)
                if at is None:
                    raise KeyError(path)
            else:
                if at.get(key) is None:
                    at[key] = {}
                at = at[key]
        if isinstance(at, list):
            held = next((i for i, x in enumerate(at) if isinstance(x, dict) and x.get("id") == keys[-1]), None)
            if held is None:
                raise KeyError(path)
            if value is None:
                del at[held]
            else:
                at[held] = value
        elif value is None:
            at.pop(keys[-1], None)
        else:
            at[keys[-1]] = deepcopy(value)
    return out


def canonical_hash(doc: dict) -> str:
    """SHA-256 of the content; the order of keys and of knobs does not matter."""
    plain = deepcopy(doc)
    if isinstance(plain.get("knobs"), list):
        plain["knobs"] = sorted(plain["knobs"], key=lambda k: str(k.get("id")))
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()


def diff(old: dict, new: dict) -> tuple[str, list[str]]:
    """``none``, ``additive`` or ``breaking``, and what is lost or changed in type."""
    if canonical_hash(old) == canonical_hash(new):
        return "none", []
    broken = []
    for section in ("entities", "interactions", "signals", "recommenders"):
        before, after = old.get(section) or {}, new.get(section) or {}
        broken += [f"{section}.{n} removed" for n in before if n not in after]
        if section == "signals":
            broken += [f"signals.{n} changed type" for n in before if n in after and (before[n] or {}).get("type") != (after[n] or {}).get("type")]
        if section == "entities":
            for n in before:
                if n in after:
                    a, b = ((x[n] or {}).get("attributes") or {} for x in (before, after))
                    broken += [f"entities.{n}.attributes.{k} removed" for k in a if k not in b]
                    broken += [f"entities.{n}.attributes.{k} changed type" for k in a if k in b and (a[k] or {}).get("type") != (b[k] or {}).get("type")]
    return ("breaking" if broken else "additive"), broken


def warnings(doc: dict) -> list[str]:
    """What the language takes but ranking does not run as such."""
    out = [f"signal {n} ({s['type']}) is not scored" for n, s in (doc.get("signals") or {}).items() if s.get("type") not in RUN_SIGNALS]
    for name, r in (doc.get("recommenders") or {}).items():
        out += [f"recommender {name}: source {s['source']} adds nothing" for s in listed(r.get("candidates")) if s["source"] not in RUN_SOURCES]
    return out


@dataclass
class Compiled:
    """A valid document with its specs by name."""

    doc: dict
    hash: str
    ranked: str
    entities: dict[str, EntitySpec] = field(default_factory=dict)

    @property
    def positive(self) -> list[str]:
        return [n for n, s in self.doc["interactions"].items() if counts_as_positive(s or {})]


def compile_schema(doc: dict) -> Compiled:
    issues = validate(doc)
    if issues:
        raise SchemaError(issues)
    out = Compiled(doc, canonical_hash(doc), ranked_type(doc))
    for name, e in doc["entities"].items():
        attrs = {}
        for a, s in ((e or {}).get("attributes") or {}).items():
            low, high = s.get("range") or (None, None)
            attrs[a] = Attribute(s["type"], bool(s.get("optional")), low, high, s.get("dim", 0), s.get("computed"))
        out.entities[name] = EntitySpec(name, attrs)
    return out


class Versions:
    """Schemas pushed one after another: dry runs, unchanged no-ops, breaking changes
    only when confirmed, and the history."""

    def __init__(self):
        self.history: list[Compiled] = []

    @property
    def current(self) -> Compiled | None:
        return self.history[-1] if self.history else None

    def load(self, text: str, dry_run: bool = False, confirm: bool = False) -> tuple[str, list[str]]:
        made = compile_schema(parse(text))
        change, broken = ("additive", []) if self.current is None else diff(self.current.doc, made.doc)
        if change == "none" or dry_run:
            return change, broken
        if change == "breaking" and not confirm:
            raise SchemaError([Issue("", "breaking change: " + ", ".join(broken))])
        self.history.append(made)
        return change, broken
