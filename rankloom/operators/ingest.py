"""From articles to the chunks that collections hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.masking import mask


def chunks(
    articles: DataFrame, key: str, text: str, chars: int = 500, overlap: int = 50,
    masking_key: str | None = None,
) -> DataFrame:
    """``(key, pos, chunk)``: pieces of up to ``chars`` characters, from 0 in reading order.

    Each chunk starts ``chars - overlap`` characters after the one before and thus
    repeats its last ``overlap``, at most half of a chunk. A rest that the chunk before holds already makes none.
    Null and empty texts have no chunk. One pass over each text, whatever its length.
    With ``masking_key`` personal data is masked first, so no chunk holds a part of it.
    """
    step = chars - overlap
    if chars < 1 or not 0 <= 2 * overlap <= chars:
        raise ValueError(f"overlap must be between 0 and {chars // 2}, got {overlap}")
    whole_text = F.col(text) if masking_key is None else mask(F.col(text), masking_key)
    steps = articles.select(
        key, F.regexp_extract_all(whole_text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_steps")
    )

    def whole(piece: Column, at: Column) -> Column:
        after = F.coalesce(F.get("_steps", at + 1), F.lit(""))
        adds = (at == 0) | (F.char_length(piece) + F.char_length(after) > overlap)
        return F.when(adds, F.concat(piece, F.left(after, F.lit(overlap))))

    # The outer form: for the other a filter is inferred that cuts the texts a second time.
    pieces = steps.select(key, F.posexplode_outer(F.transform("_steps", whole)).alias("pos", "chunk"))
    return pieces.where("chunk IS NOT NULL")
