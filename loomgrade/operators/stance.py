"""How a text stands to a forbidden operation that it names: recommends it, warns against it, or only mentions it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrade.functions.fixed import CAUTION_CUES, ENDORSEMENT_CUES

CONTEXT = 120  # bytes on either side of a hit
STANCES = ("absent", "neutral_mention", "warns_against", "recommends")


def stance(text: Column, token: str, context: int = CONTEXT) -> Column:
    """The worst stance over all hits of a token, case aside: `absent`, `neutral_mention`, `warns_against` or `recommends`.

    A hit's window is `context` bytes on either side. A caution in it outweighs an endorsement, so "never run x" warns; without either
    it is a mention. Hits do not overlap. Bytes that a window cuts off a character never make or break a cue, which are all ASCII. A null text is absent.
    Linear in the text: a pass over the pieces between hits keeps the place, and windows are cut from the text's bytes.
    """
    low = token.lower()
    if not low:
        raise ValueError("a token has one character at least")
    whole = F.lower(F.coalesce(text, F.lit("")))
    size = len(low.encode())
    quoted = "\\Q" + low.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    cue = lambda window, cues: F.exists(F.array(*[F.lit(c).cast("binary") for c in cues]), lambda c: F.contains(window, c))

    def worst(own: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            at = state["at"] + F.octet_length(piece)
            start = F.greatest(at - context, F.lit(0))
            window = F.substring(own["data"], start + 1, at - start + size + context)
            found = F.transform(F.array(window), lambda w: F.when(cue(w, CAUTION_CUES), 2).when(cue(w, ENDORSEMENT_CUES), 3).otherwise(1))
            return F.struct((at + size).alias("at"), F.greatest(state["worst"], F.get(found, 0)).alias("worst"))

        pieces = F.split(own["text"], quoted, -1)
        hits = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
        return F.aggregate(hits, F.struct(F.lit(0).alias("at"), F.lit(0).alias("worst")), step, lambda s: s["worst"])

    # an array of one binds the text and its bytes, so that no hit makes them again
    bound = F.array(F.struct(whole.alias("text"), whole.cast("binary").alias("data")))
    return F.element_at(F.array(*[F.lit(s) for s in STANCES]), F.get(F.transform(bound, worst), 0) + 1)


def is_safe(stance_: Column) -> Column:
    return stance_ != "recommends"
