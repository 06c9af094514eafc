"""Content identities.

An identity is the SHA-256, in 64 lower-case hex digits, of a sequence of parts,
each followed by U+001F: ``kind`` and the kind, then for every field its name and
its content.  Text is normalized; an identity is the tag ``<identity>`` and its
32 octets; opaque octets are the tag ``<opaque>`` and their SHA-256; an absent
field is the tag ``<absent>``.  Field order, names and kind count, exclusions do
not.  Everything is a native expression, so it runs inside generated code.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from stelae.functions.normalize import normalized, normalized_sql

HEX_64 = r"^[0-9a-f]{64}\z"
SEPARATOR = "\x1f"
_HEX_DIGITS = r"[^0-9a-f]"


def _constant(text: str) -> Column:
    return F.lit(bytearray(text.encode()))


@dataclass(frozen=True)
class Derivation:
    """A kind, its ordered fields, and what is left out and why."""

    kind: str
    parts: tuple[Column, ...] = ()
    included: tuple[str, ...] = ()
    excluded: tuple[tuple[str, str], ...] = field(default=())

    def _with(self, name: str, *contents: Column) -> Derivation:
        return replace(self, parts=(*self.parts, _constant(name), *contents), included=(*self.included, name))

    def text(self, name: str, value: Column, normal: bool = False) -> Derivation:
        """A text field; empty text takes part.  ``normal`` says that the value is in
        normal form already."""
        return self._with(name, F.encode(value if normal else normalized(value), "UTF-8"))

    def identity(self, name: str, value: Column) -> Derivation:
        """A field that holds another identity in hex."""
        return self._with(name, _constant("<identity>"), F.unhex(value))

    def octets(self, name: str, value: Column) -> Derivation:
        """A field of opaque octets, not normalized."""
        return self._with(name, _constant("<opaque>"), F.unhex(F.sha2(value, 256)))

    def absent(self, name: str) -> Derivation:
        """A field that holds its place without a value."""
        return self._with(name, _constant("<absent>"))

    def excluding(self, name: str, because: str) -> Derivation:
        """Record that a field takes no part; the identity does not change."""
        return replace(self, excluded=(*self.excluded, (name, because)))

    def seal(self) -> Column:
        """The identity; null if a field is null."""
        mark = _constant(SEPARATOR)
        parts = (_constant("kind"), _constant(self.kind), *self.parts)
        return F.sha2(F.concat(*(x for part in parts for x in (part, mark))), 256)


def document_identity(content: Column) -> Column:
    return (
        Derivation("document")
        .octets("content", content)
        .excluding("source", "the same octets from two places are one document")
        .excluding("arrival", "when octets came says nothing of what they are")
        .seal()
    )


def concept_identity(name: Column, normal: bool = False) -> Column:
    return (
        Derivation("concept")
        .text("canonical_name", name, normal)
        .excluding("source", "two sources that name a concept name one concept")
        .seal()
    )


def claim_identity(concept: Column, text: Column, normal: bool = False) -> Column:
    return (
        Derivation("claim")
        .identity("concept", concept)
        .text("text", text, normal)
        .excluding("source", "a claim made twice is one claim with two citations")
        .excluding("scope", "a scope belongs to the citation")
        .seal()
    )


def assertion_identity(claim: Column, source: Column, scope: Column, normal: bool = False) -> Column:
    return (
        Derivation("assertion")
        .identity("claim", claim)
        .text("source", source, normal)
        .text("scope", scope, normal)
        .excluding("strength", "how strongly a source claims is not what it claims")
        .seal()
    )


def is_identity(value: Column) -> Column:
    """True for 64 lower-case hex digits and nothing else."""
    return F.coalesce(value.rlike(HEX_64), F.lit(False))


def identity_refusal(value: Column) -> Column:
    """Why a text is no identity: its length first, then its first foreign
    character by name; null if it is one."""
    return (
        F.when(value.isNull(), F.lit("absent"))
        .when(F.char_length(value) != 64, F.concat(F.lit("wrong length "), F.char_length(value).cast("string")))
        .when(value.rlike(_HEX_DIGITS), F.concat(F.lit("not a digit "), F.regexp_extract(value, f"({_HEX_DIGITS})", 1)))
    )


def _sealed_sql(kind: str, *parts: str) -> str:
    mark = "'\\x1F'::BLOB"
    head = f"'kind\\x1F{kind}\\x1F'::BLOB"
    return "sha256(" + " || ".join([head, *(f"{p} || {mark}" for p in parts)]) + ")"


def document_sql(content: str) -> str:
    return _sealed_sql("document", "'content'::BLOB", "'<opaque>'::BLOB", f"unhex(sha256({content}))")


def concept_sql(name: str) -> str:
    return _sealed_sql("concept", "'canonical_name'::BLOB", f"encode({normalized_sql(name)})")


def claim_sql(concept: str, text: str) -> str:
    return _sealed_sql(
        "claim", "'concept'::BLOB", "'<identity>'::BLOB", f"unhex({concept})", "'text'::BLOB", f"encode({normalized_sql(text)})"
    )


def assertion_sql(claim: str, source: str, scope: str) -> str:
    return _sealed_sql(
        "assertion", "'claim'::BLOB", "'<identity>'::BLOB", f"unhex({claim})",
        "'source'::BLOB", f"encode({normalized_sql(source)})", "'scope'::BLOB", f"encode({normalized_sql(scope)})",
    )
