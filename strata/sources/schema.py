"""JSON Schema of the wire form, generated from the shapes that the reader checks."""

from __future__ import annotations

import hashlib
import json

from strata.sources.wire import _SPELLINGS, DECLARATIONS, SHAPES

_CHOICES = {
    "relation_declaration": DECLARATIONS,
    "relation": ("polyadic_instance", "binary_instance"),
    "endpoint": ("durable_position", "item_reference"),
    "anchor": ("item_anchor", "tier_anchor"),
}
_CONSTANTS = {"simple": "simple", "bipartite": "bipartite", "polyadic": "polyadic", "item_anchor": "item", "tier_anchor": "tier"}


def _of(shape: str) -> dict:
    if shape.startswith("["):
        return {"type": "array", "items": _of(shape[1:])}
    plain, optional = shape.removesuffix("?"), shape.endswith("?")
    kind = {"filled": "string", "natural": "integer"}.get(plain, plain)
    if kind in ("string", "integer", "boolean"):
        bound = {"filled": {"minLength": 1}, "natural": {"minimum": 0}}.get(plain, {})
        return {"type": [kind, "null"] if optional else kind} | bound
    return {"$ref": f"#/$defs/{shape}"}


def _definition(name: str) -> dict:
    if name in _CHOICES:
        return {"anyOf": [{"$ref": f"#/$defs/{x}"} for x in _CHOICES[name]]}
    if name in _SPELLINGS:
        return {"enum": list(_SPELLINGS[name])}
    fields = SHAPES[name]
    properties = {k: {"const": _CONSTANTS[name]} if k == "kind" and name in _CONSTANTS else _of(v) for k, v in fields.items()}
    return {"type": "object", "additionalProperties": False, "required": sorted(fields), "properties": properties}


def json_schema() -> dict:
    names, todo = set(), ["document"]
    while todo:
        name = todo.pop()
        if name in names:
            continue
        names.add(name)
        inside = _CHOICES.get(name) or [v.lstrip("[") for v in SHAPES.get(name, {}).values()]
        todo += [x for x in inside if x in SHAPES or x in _CHOICES or x in _SPELLINGS]
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "$ref": "#/$defs/document", "$defs": {n: _definition(n) for n in sorted(names)}}


def shape_hash() -> str:
    return hashlib.sha256(json.dumps(json_schema(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def validation_errors(value, schema: dict | None = None, path: str = "$", whole: dict | None = None) -> list[tuple[str, str]]:
    """(path, message) of every part of a parsed document that the schema refuses; of several choices the one that fails least."""
    whole = json_schema() if whole is None else whole
    schema = whole if schema is None else schema
    if "$ref" in schema:
        return validation_errors(value, whole["$defs"][schema["$ref"].rpartition("/")[2]], path, whole)
    if "anyOf" in schema:
        return min((validation_errors(value, s, path, whole) for s in schema["anyOf"]), key=len)
    if "const" in schema:
        return [] if value == schema["const"] else [(path, f"must be {schema['const']}")]
    if "enum" in schema:
        return [] if value in schema["enum"] else [(path, f"must be one of {', '.join(schema['enum'])}")]
    kinds = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
    checks = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "null": type(None)}
    if not any(isinstance(value, checks[k]) and not (k == "integer" and isinstance(value, bool)) for k in kinds):
        return [(path, f"must be {' or '.join(kinds)}")]
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        return [(path, "must not be empty")]
    if isinstance(value, int) and value < schema.get("minimum", value):
        return [(path, f"must not be below {schema['minimum']}")]
    if isinstance(value, dict):
        out = [(path, f"missing {k}") for k in schema["required"] if k not in value] + [(path, f"unknown {k}") for k in value if k not in schema["properties"]]
        return out + [e for k, v in value.items() if k in schema["properties"] for e in validation_errors(v, schema["properties"][k], f"{path}.{k}", whole)]
    if isinstance(value, list):
        return [e for i, v in enumerate(value) for e in validation_errors(v, schema["items"], f"{path}[{i}]", whole)]
    return []
