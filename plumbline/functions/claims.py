"""Sentences and classes: what a learned claim says, and which names mean the same constant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.paths import NAMING_CLASSES

#: What a template holds where its class goes.
STYLE = "<style>"


def same_constant(written: Column, learned: Column, nesting: Column) -> Column:
    """Whether two constant names are one: equal, or one bare and the other it within a scope of `nesting`."""
    scoped = lambda name: F.contains(name, F.lit("::"))
    bare, full = F.when(scoped(written), learned).otherwise(written), F.when(scoped(written), written).otherwise(learned)
    resolved = ~scoped(bare) & scoped(full) & F.exists(F.coalesce(nesting, F.array().cast("array<string>")), lambda scope: F.concat(scope, F.lit("::"), bare) == full)
    return F.coalesce((written == learned) | resolved, F.lit(False))


def claim_for(template: Column, none_claim: Column, cls: Column) -> Column:
    """A learned row's sentence: the template with its class, or the sentence of its own for learning that there is none."""
    return F.when((cls == "none") & none_claim.isNotNull(), none_claim).otherwise(F.replace(template, F.lit(STYLE), cls))


def enforceable(cls: Column, from_source: Column, none_claim: Column) -> Column:
    """Whether a stored class may be held against code: a name from the source that is not empty, a prefix letter or `none`
    where none can be learned, else one of the naming classes."""
    named = F.length(F.trim(cls)) > 0
    return F.coalesce(F.when(from_source, named).when(none_claim.isNotNull(), cls.rlike("^([A-Z]|none)$")).otherwise(cls.isin(*[c for c, _ in NAMING_CLASSES])), F.lit(False))
