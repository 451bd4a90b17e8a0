"""The declarative spec: entities, typed fields, constraints.

A spec is small driver-side configuration. Everything here runs once, while the query is
being built; rows only ever see the Columns derived from it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property
from typing import Any

# JSON type of each declared type; any other name counts as a string.
JSON_TYPES = {
    "string": "string",
    "int": "integer",
    "float": "number",
    "bool": "boolean",
    "list[string]": "array",
    "list[int]": "array",
    "list[float]": "array",
    "list[bool]": "array",
}

# Words, runs of operator signs and single other signs of a constraint's text.
TOKEN = re.compile(r"(?P<word>\w+)|(?P<operator>[<>=!]+)|(?P<sign>\S)")
SEVERITIES = ("error", "warning", "info")


class SpecError(ValueError):
    """The spec itself is malformed."""


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    enum: tuple[str, ...] | None = None
    range: tuple[float, float] | None = None
    description: str | None = None
    required: bool = True
    default: Any = None
    min_length: int | None = None
    max_length: int | None = None

    @property
    def json_type(self) -> str:
        """The JSON type a value must have; an enum field is always a string."""
        return "string" if self.enum else JSON_TYPES.get(self.type, "string")

    @property
    def item_type(self) -> str | None:
        """The JSON type of list items, for list fields."""
        if self.json_type != "array":
            return None
        return JSON_TYPES[self.type.removeprefix("list[").removesuffix("]")]

    @property
    def json_range(self) -> tuple[float, float] | None:
        """The range the JSON schema enforces: plain int and float fields only."""
        return self.range if self.type in ("int", "float") and not self.enum else None

    @classmethod
    def parse(cls, entity: str, name: str, body: Any) -> Field:
        if not isinstance(body, Mapping):
            body = {"type": str(body)}
        where = f"{entity}.{name}"
        kind = body.get("type")
        if not kind or not isinstance(kind, str):
            raise SpecError(f"{where}: missing type")
        enum = body.get("enum")
        if enum is not None:
            if not isinstance(enum, (list, tuple)):
                raise SpecError(f"{where}: enum must be a list")
            if not enum:
                raise SpecError(f"{where}: enum cannot be empty")
            if not all(isinstance(value, str) for value in enum):
                raise SpecError(f"{where}: enum values must be strings")
            enum = tuple(enum)
        bounds = body.get("range")
        if bounds is not None:
            if not isinstance(bounds, (list, tuple)) or len(bounds) != 2:
                raise SpecError(f"{where}: range must be a (min, max) pair")
            bounds = (float(bounds[0]), float(bounds[1]))
            if not bounds[0] < bounds[1]:
                raise SpecError(f"{where}: range min must be less than max")
        return cls(
            name=name,
            type=kind,
            enum=enum,
            range=bounds,
            description=body.get("description"),
            required=bool(body.get("required", True)),
            default=body.get("default"),
            min_length=body.get("minLength"),
            max_length=body.get("maxLength"),
        )


@dataclass(frozen=True)
class Entity:
    name: str
    fields: tuple[Field, ...]
    description: str | None = None

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required_names(self) -> list[str]:
        return [f.name for f in self.fields if f.required]


@dataclass(frozen=True)
class LengthRule:
    """``len(field) op number``; ``number`` stays text, it may not be a number."""

    field: str
    op: str
    number: str


@dataclass(frozen=True)
class CompareRule:
    """``field op value``; ``value`` is the text to the right of the operator."""

    field: str
    op: str
    value: str


def comparisons(text: str) -> list[LengthRule | CompareRule]:
    """The comparisons in a constraint's text, in order.

    A comparison is a field's name or ``len(name)``, an operator, and all text up to the next
    operator. Anything else between them is passed over.
    """
    tokens = list(TOKEN.finditer(text))
    operators = [i for i, t in enumerate(tokens) if t.lastgroup == "operator"]
    found = []
    for nth, at in enumerate(operators):
        follows = operators[nth + 1 : nth + 2]
        right = text[tokens[at].end() : tokens[follows[0]].start() if follows else len(text)].lstrip()
        left, op = tokens[max(0, at - 4) : at], tokens[at].group()
        if not right or not left:
            continue
        if left[-1].lastgroup == "word":
            found.append(CompareRule(left[-1].group(), op, right))
        elif len(left) == 4 and left[2].lastgroup == "word":
            # A call is written without blanks.
            call = text[left[0].start() : left[-1].end()]
            if call == f"len({left[2].group()})":
                found.append(LengthRule(left[2].group(), op, right))
    return found


@dataclass(frozen=True)
class Constraint:
    expr: str
    message: str | None = None
    severity: str = "error"

    @cached_property
    def parsed(self) -> list[LengthRule | CompareRule]:
        return comparisons(self.expr)

    @cached_property
    def lengths(self) -> list[LengthRule]:
        return [c for c in self.parsed if isinstance(c, LengthRule)]

    @cached_property
    def calls_len(self) -> bool:
        words = [t.group() for t in TOKEN.finditer(self.expr)]
        return any(pair == ("len", "(") for pair in zip(words, words[1:], strict=False))

    @cached_property
    def rule(self) -> LengthRule | CompareRule | None:
        """What a row has to satisfy; None when the text constrains nothing.

        A text that calls ``len`` is about a length only, whose limit is the digits it starts with.
        """
        if not self.calls_len:
            return next((c for c in self.parsed if isinstance(c, CompareRule)), None)
        for length in self.lengths:
            if digits := re.match(r"\d+", length.number):
                return LengthRule(length.field, length.op, digits.group())
        return None

    @cached_property
    def simple_length(self) -> LengthRule | None:
        """The narrower reading used by record validation: one bound, ``<=`` or ``>=``, in full."""
        for length in self.lengths:
            if length.op in ("<=", ">="):
                return LengthRule(length.field, length.op, length.number.strip())
        return None


@dataclass(frozen=True)
class Spec:
    name: str
    entities: tuple[Entity, ...]
    constraints: tuple[Constraint, ...] = ()
    examples: tuple[Mapping[str, Any], ...] = ()
    description: str | None = None
    version: str | None = None

    def entity(self, name: str) -> Entity:
        for entity in self.entities:
            if entity.name == name:
                return entity
        raise KeyError(name)

    @property
    def entity_names(self) -> list[str]:
        return [e.name for e in self.entities]

    @property
    def field_names(self) -> list[str]:
        """All declared keys, each once."""
        return list(dict.fromkeys(f.name for e in self.entities for f in e.fields))

    @classmethod
    def from_dict(cls, body: Mapping[str, Any]) -> Spec:
        """Build a spec, rejecting a malformed one before any job is planned."""
        entities = tuple(
            Entity(
                name=name,
                fields=tuple(
                    Field.parse(name, fname, fbody)
                    for fname, fbody in (ebody.get("fields") or {}).items()
                ),
                description=ebody.get("description"),
            )
            for name, ebody in (body.get("entities") or {}).items()
        )
        constraints = []
        for position, item in enumerate(body.get("constraints") or []):
            rule = Constraint(item["expr"], item.get("message"), item.get("severity", "error"))
            if not rule.expr.strip():
                raise SpecError(f"constraint {position}: empty expression")
            if rule.severity not in SEVERITIES:
                raise SpecError(f"constraint {position}: unknown severity {rule.severity!r}")
            constraints.append(rule)
        examples = tuple(body.get("examples") or [])
        for position, pair in enumerate(examples):
            if "input" not in pair or "output" not in pair:
                raise SpecError(f"example {position}: needs input and output")
        return cls(
            name=body.get("name", "spec"),
            entities=entities,
            constraints=tuple(constraints),
            examples=examples,
            description=body.get("description"),
            version=body.get("version"),
        )
