"""Contracts read from their JSON Schema document.

The document describes one object with one array of tagged elements. What a ``Contract`` can state is
compiled; a keyword that it cannot state is refused, so that no rule of the document is lost unseen.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from assayline.operators.contract import Contract, Field

# Keywords that say something about a value without limiting it.
NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "deprecated"}
TAG = "type"
Schema = Mapping[str, Any]


def _resolved(node: Schema, document: Schema, seen: tuple[str, ...] = ()) -> dict[str, Any]:
    """The limits of a schema node, with its ``$ref`` followed and its notes left out."""
    own = {k: v for k, v in node.items() if k not in NOTES and k != "$ref"}
    ref = node.get("$ref")
    if ref is None:
        return own
    if ref in seen:
        raise ValueError(f"{ref} refers to itself")
    if not ref.startswith("#"):
        raise ValueError(f"{ref} lies outside the document")
    target: Any = document
    for step in ref[1:].split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if not isinstance(target, Mapping) or step not in target:
            raise ValueError(f"{ref} leads nowhere")
        target = target[step]
    found = _resolved(target, document, (*seen, ref))
    if any(found.get(k, v) != v for k, v in own.items()):
        raise ValueError(f"{ref} is limited once more beside the reference")
    return found | own


def _only(node: Schema, allowed: set[str], where: str) -> None:
    if unknown := sorted(set(node) - allowed):
        raise ValueError(f"{where}: a contract cannot state {', '.join(unknown)}")


def _closed_object(node: Schema, where: str, more: set[str] = frozenset()) -> tuple[Schema, list[str]]:
    """Properties and required names of an object that allows no other keys."""
    _only(node, {"type", "properties", "required", "additionalProperties", *more}, where)
    if node.get("type") != "object" or node.get("additionalProperties") is not False:
        raise ValueError(f"{where}: not an object with additionalProperties false")
    properties, required = node.get("properties", {}), list(node.get("required", []))
    if unknown := sorted(set(required) - set(properties)):
        raise ValueError(f"{where}: required but not described: {', '.join(unknown)}")
    return properties, required


def _field(node: Schema, document: Schema, required: bool, where: str) -> tuple[Field, str | None]:
    """The rule of one property, and the pattern of its colours if it holds any."""
    if node.get("type") in ("number", "integer"):
        _only(node, {"type", "minimum", "maximum", "exclusiveMinimum"}, where)
        return Field(node["type"], node.get("minimum"), node.get("maximum"), node.get("exclusiveMinimum"), required=required), None
    if node.get("type") == "boolean":
        _only(node, {"type"}, where)
        return Field("boolean", required=required), None
    if node.get("type") == "array":
        _only(node, {"type", "items", "minItems", "maxItems"}, where)
        item = _resolved(node.get("items", {}), document)
        _only(item, {"type", "pattern"}, f"{where}, items")
        if item.get("type") != "string" or "pattern" not in item:
            raise ValueError(f"{where}: only arrays of colours can be stated")
        return Field("colours", min_items=node.get("minItems"), max_items=node.get("maxItems"), required=required), item["pattern"]
    _only(node, {"type", "enum", "pattern"}, where)
    values = tuple(node.get("enum", ()))
    if node.get("type", "string" if values else None) != "string" or not all(isinstance(v, str) for v in values):
        raise ValueError(f"{where}: neither number, boolean, text nor array of colours")
    if "pattern" not in node:
        return Field("string", values=values, required=required), None
    if values:
        raise ValueError(f"{where}: a pattern beside an enum")
    return Field("colour", required=required), node["pattern"]


def _needs(conditions: list[Schema], kind: str, properties: Schema) -> dict[tuple[str, str, str], tuple[str, ...]]:
    """Sizes that a choice of a sub-kind needs, from ``allOf`` of ``if`` (one constant) and ``then`` (required)."""
    found = {}
    for n, condition in enumerate(conditions):
        where = f"{kind}, allOf {n}"
        _only(condition, {"if", "then"}, where)
        asked, then = condition.get("if", {}), condition.get("then", {})
        _only(asked, {"properties", "required"}, where)
        _only(then, {"required"}, where)
        chosen = asked.get("properties", {})
        if [set(c) for c in chosen.values()] != [{"const"}]:
            raise ValueError(f"{where}: not one constant")
        ((selector, choice),) = chosen.items()
        sizes = tuple(then.get("required", ()))
        if selector not in properties or not set(sizes) <= set(properties):
            raise ValueError(f"{where}: speaks of a property that is not described")
        at = (kind, selector, choice["const"])
        found[at] = (*found.get(at, ()), *sizes)
    return found


def contract_from_schema(
    schema: str | Schema, needs: Mapping[tuple[str, str, str], tuple[str, ...]] | None = None
) -> Contract:
    """The contract that a JSON Schema (text or parsed) states.

    The root is a closed object whose one required property is an array of at least one element; elements are
    ``oneOf`` closed objects told apart by a constant ``type``. Local ``$ref`` is followed. A string with a
    ``pattern`` is a colour, and all colours of a document share one pattern. ``needs`` adds rules that the
    document only states in prose. Anything that the contract cannot hold raises ``ValueError``.
    """
    document = json.loads(schema) if isinstance(schema, str) else schema
    properties, required = _closed_object(_resolved(document, document), "document")
    if len(properties) != 1 or required != list(properties):
        raise ValueError("document: not one required array")
    (root,) = properties
    array = _resolved(properties[root], document)
    _only(array, {"type", "minItems", "items"}, root)
    if array.get("type") != "array" or array.get("minItems") != 1:
        raise ValueError(f"{root}: not an array of at least one element")
    element = _resolved(array.get("items", {}), document)
    _only(element, {"oneOf"}, f"{root}, items")

    types, patterns, asked = {}, set(), {}
    for option in element.get("oneOf", []):
        node = _resolved(option, document)
        described, needed = _closed_object(node, f"{root}, items", {"allOf"})
        tag = _resolved(described.get(TAG, {}), document)
        kind = tag.get("const")
        if not isinstance(kind, str) or set(tag) - {"const", "type"} or TAG not in needed or kind in types:
            raise ValueError(f"{root}, items: no constant and required {TAG} of its own")
        types[kind] = {}
        for name, value in described.items():
            if name != TAG:
                field, pattern = _field(_resolved(value, document), document, name in needed, f"{kind}.{name}")
                types[kind][name] = field
                patterns |= {pattern} - {None}
        asked |= _needs(node.get("allOf", []), kind, described)
    if not types:
        raise ValueError(f"{root}, items: no kinds of elements")
    if len(patterns) > 1:
        raise ValueError(f"more than one pattern of colours: {', '.join(sorted(patterns))}")
    stated = asked | dict(needs or {})
    return Contract(types, *patterns, needs=stated or None, root=root)
