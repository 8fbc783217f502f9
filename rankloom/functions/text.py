"""Text expressions: every function takes and returns ``Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply texts and labels a caller of the service sees.
DISCLAIMER = (
    "⚠️ Bu bilgi tıbbi tavsiye değildir. "
    "Sağlık kararlarınız için mutlaka hekiminize danışın."
)
CITATION_LABEL = "Kaynak"
EMPTY_QUESTION_REPLY = "Lütfen bir soru girin."
EMPTY_QUESTION_ERROR = "Question cannot be empty"
NO_HITS_REPLY = "Bu soruyla ilgili bilgi bulamadım. Lütfen sorunuzu farklı şekilde ifade etmeyi deneyin."
NO_CONTEXT_REPLY = (
    "Üzgünüm, bu soruyla ilgili bilgi bulamadım. "
    "Lütfen sorunuzu farklı şekilde ifade etmeyi deneyin."
)
MODEL_FAILURE_REPLY = "Üzgünüm, şu anda cevap oluşturamıyorum. Lütfen tekrar deneyin."
STAGE_FAILURE_REPLIES = {
    "embedding": "Sorunuzu işlerken bir hata oluştu. Lütfen tekrar deneyin.",
    "database": "Veritabanı bağlantısı kurulamadı. Lütfen daha sonra tekrar deneyin.",
    "rag": "Cevap oluşturulurken bir hata oluştu. Lütfen tekrar deneyin.",
    "unexpected": "Beklenmeyen bir hata oluştu. Lütfen daha sonra tekrar deneyin.",
}
STAGE_FAILURE_PREFIXES = {
    "embedding": "Embedding error: ",
    "database": "Database error: ",
    "rag": "",
    "unexpected": "Unexpected error: ",
}
SYSTEM_PROMPT = """Sen bir sağlık bilgi asistanısın. Sağlık konularında bilgilendirme yapıyorsun.

ÖNEMLİ KURALLAR:
1. Verilen KAYNAK bilgilerini kullanarak cevap ver
2. Kaynak göster: [Kaynak 1], [Kaynak 2] şeklinde
3. MUTLAKA tıbbi sorumluluk reddi ekle
4. Teşhis veya tedavi önerme, sadece bilgilendir
5. Türkçe ve anlaşılır cevap ver
6. Bilmiyorsan veya kaynaklarda yoksa belirt

SORUMLULUK REDDİ (MUTLAKA EKLE):
{disclaimer}
"""
USER_PROMPT = """SORU: {question}

KAYNAK BİLGİLER:
{context}

Yukarıdaki kaynaklara dayanarak soruyu cevapla. Kaynak numaralarını belirt ve tıbbi sorumluluk reddi ekle."""
# The characters str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove all Unicode whitespace at both ends (``trim`` alone removes blanks only)."""
    return F.trim(text, F.lit(WHITESPACE))


def truncate(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def ellipsize(text: Column, n: int) -> Column:
    """Cut to ``n`` characters and mark the cut; shorter text is unchanged."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def preview(text: Column, n: int) -> Column:
    """Cut to ``n`` characters and always append dots."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def with_disclaimer(answer: Column, disclaimer: str = DISCLAIMER) -> Column:
    return F.when(F.contains(answer, F.lit(disclaimer)), answer).otherwise(
        F.concat(answer, F.lit("\n\n" + disclaimer))
    )


def reply(text: str, disclaimer: str = DISCLAIMER) -> Column:
    return F.lit(f"{text}\n\n{disclaimer}")


def cache_key(question: Column, top_k: int, model: str) -> Column:
    """sha256 of the stripped question with the two settings that change an answer."""
    return F.sha2(
        F.concat(F.lit("q="), strip(question), F.lit(f"|topk={top_k}|model={model}")), 256
    )


def question_problem(raw: Column, shortest: int = 3, longest: int = 500) -> Column:
    """Reason a question is refused, or null. The raw length is judged first."""
    bare = strip(raw)
    return (
        F.when(raw.isNull(), F.lit("missing"))
        .when(F.char_length(raw) < shortest, F.lit("too_short"))
        .when(F.char_length(raw) > longest, F.lit("too_long"))
        .when(bare == "", F.lit("empty"))
        .when(F.char_length(bare) < shortest, F.lit("too_short_stripped"))
    )


def citation(position: Column, label: str = CITATION_LABEL) -> Column:
    return F.concat(F.lit(f"[{label} "), position.cast("string"), F.lit("]"))


def prompt(template: str, **columns: Column) -> Column:
    """Fill ``{name}`` slots of a template with columns, as one concat."""
    parts: list[Column] = []
    rest = template
    while rest:
        slots = [(rest.find("{" + n + "}"), n) for n in columns if "{" + n + "}" in rest]
        if not slots:
            parts.append(F.lit(rest))
            break
        at, name = min(slots)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(columns[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def file_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def in_quiet_hours(ts: Column, start: str, end: str) -> Column:
    """Half-open ``[start, end)`` on the clock; may cross midnight. Equal bounds: always."""
    if not start or not end:
        return F.lit(False)
    low, high = (int(h) * 60 + int(m) for h, m in (start.split(":"), end.split(":")))
    minute = F.hour(ts) * 60 + F.minute(ts)
    if low < high:
        return (minute >= low) & (minute < high)
    return (minute >= low) | (minute < high)


def backoff_seconds(attempt: Column, base: float = 0.2) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def json_message(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text")))
