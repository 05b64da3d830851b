"""Label text, verdicts and names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gambrel.functions.polygon import let

MIN_SCORE, MIN_CHARS = 0.45, 2

#: What ends a line, and white space at its ends.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def room_name(name: Column) -> Column:
    """Trimmed, in capitals; null is empty."""
    return F.upper(F.trim(F.coalesce(name, F.lit(""))))


def token(text: Column) -> Column:
    """L1: a token in capitals, with a plain minus."""
    return F.translate(F.upper(F.trim(text)), "−", "-")


def is_token(text: Column, score: Column, least: float = MIN_SCORE) -> Column:
    """L1: scored well enough, two characters or more, and not a number once ``. - +`` are gone."""
    t = token(text)
    return (score >= least) & (F.char_length(t) >= MIN_CHARS) & ~F.rlike(F.translate(t, ".-+", ""), F.lit("^[0-9]+$"))


def is_callout(name: Column) -> Column:
    """A dimension such as R200 or R200X90."""
    return F.rlike(name, F.lit(r"^R\d+(X\d+)?$"))


def joined_label(parts: Column) -> Column:
    """L3: parts (struct<cy,cx,text>) in reading order, run-together and repeated ROOMs mended; null for a bare ROOM."""
    words = F.array_join(F.transform(F.sort_array(parts), lambda p: p["text"]), " ")
    for old, new in (("MEETINGROOM", "MEETING ROOM"), ("MEETING ROOM ROOM", "MEETING ROOM"), ("ROOM ROOM", "ROOM")):
        words = F.replace(words, F.lit(old), F.lit(new))
    return F.when(words != "ROOM", words)


def page_label(text: Column, page: Column) -> Column:
    """The first line in capitals of 3 to 40 characters with DENAH, else the first such line, else Halaman n."""
    # a run of blanks is tried once, at its start
    bare = lambda x: F.regexp_replace(x, f"^{BLANK}++|(?<!{BLANK}){BLANK}++$", "")
    capital = F.filter(F.split(text, LINE_END), lambda x: F.upper(x) == x)
    lines = F.filter(F.transform(capital, bare), lambda x: F.char_length(x).between(3, 40) & F.rlike(x, F.lit(r"\p{L}")))
    found = let(lines, lambda some: F.coalesce(F.get(F.filter(some, lambda x: F.contains(x, F.lit("DENAH"))), F.lit(0)), F.get(some, F.lit(0))))
    return F.coalesce(found, F.concat(F.lit("Halaman "), page.cast("string")))


def file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.coalesce(path, F.lit("")), "/+$", ""), "[^/]*$", 0)


def stem(name: Column, fallback: str) -> Column:
    """The file's name without folder and extension: letters, digits, - and _; anything else as _; at most 80
    characters.
    """
    bare = F.regexp_replace(file_name(name), r"(?s)^(.+)\.[^.]+$", "$1")
    kept = F.substring(F.regexp_replace(bare, r"[^\p{L}\p{N}_-]", "_"), 1, 80)
    return F.when(kept == "", F.lit(fallback)).otherwise(kept)


def extension(filename: Column, content_type: Column) -> Column:
    """Of the file name if it has a known one, else of the content type, else .png."""
    known = F.regexp_extract(F.lower(file_name(filename)), r"(?<=.)\.(png|jpe?g|webp|bmp|gif)$", 0)
    kind = F.lower(content_type)
    by_type = F.when(kind.isin("image/jpeg", "image/jpg"), ".jpg")
    for name in ("webp", "bmp", "gif"):
        by_type = by_type.when(kind == f"image/{name}", f".{name}")
    return F.when(known != "", known).otherwise(F.coalesce(by_type, F.lit(".png")))


def outline_verdict(distance: Column) -> Column:
    """F5."""
    return F.when(distance < 0.15, "sangat dekat").when(distance < 0.4, "sedang").otherwise("jauh")


def band(similarity: Column) -> Column:
    """High above .75, medium above .45, else low."""
    return F.when(similarity > 0.75, "high").when(similarity > 0.45, "medium").otherwise("low")


def agreement(overlap: Column, distance: Column) -> Column:
    """whether overlap and outline distance say the same."""
    near, far = distance < 0.15, distance >= 0.4
    return F.when((overlap > 0.75) & near, "both close").when((overlap <= 0.45) & far, "both far").when((overlap > 0.75) & far, "overlap only").when((overlap <= 0.45) & near, "outline only").otherwise("mixed")


def source_of_name(name: Column, typed: Column) -> Column:
    """Diketik where a person typed it, else tulisan, or kosong without a name."""
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "kosong").when(typed, "diketik").otherwise("tulisan")
