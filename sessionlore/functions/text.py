"""String columns: stripping, labels, file names, previews, templates, and the
two greedy splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a text.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f \u0085  "
    "               　"
)
# What ends a line of a transcript.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
# Limits in characters.
MESSAGE_LIMIT, ERROR_LIMIT, PREVIEW_LIMIT = 1900, 1800, 110
SINGLE_PASS_LIMIT, CHUNK_LIMIT = 90_000, 45_000
# Headings and texts.
TRANSCRIPT_HEADING, TRANSCRIPT_PROMPT = "# Transcript", "Session transcript:\n"
NO_NOTES_ANSWER = "I do not have any campaign notes saved yet."


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Unicode white space off both ends (``trim`` takes only spaces)."""
    return F.btrim(col(c), F.lit(WHITE_SPACE))


def filled(c: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(col(c), F.lit(""))


def is_usable(c: Column | str) -> Column:
    """Whether a text has more than white space; a null has not."""
    return strip(F.coalesce(col(c), F.lit(""))) != ""


def display_label(display_name: Column | str, name: Column | str, user_id: Column | str) -> Column:
    """The display name unless empty, else the account name even if empty, else
    the id."""
    return F.coalesce(filled(display_name), col(name), col(user_id).cast("string"))


def speaker_label(character_name: Column | str, display_name: Column | str) -> Column:
    """The character name unless null or empty (not trimmed), else the display name."""
    return F.coalesce(filled(character_name), col(display_name))


def collapsed(c: Column | str) -> Column:
    """Runs of white space as single spaces, none at the ends."""
    return strip(F.regexp_replace(col(c), f"[{WHITE_SPACE}]+", " "))


def preview(c: Column | str, limit: int = PREVIEW_LIMIT) -> Column:
    text = collapsed(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def safe_name(c: Column | str, default: str = "speaker") -> Column:
    """Letters and digits, anything else as ``_``, none of these at the ends."""
    name = F.btrim(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", "_"), F.lit("_"))
    return F.coalesce(filled(name), F.lit(default))


def archive_name(started_at: Column | str, user_id: Column | str, name: Column | str, suffix: str = ".skopus") -> Column:
    return F.concat_ws("_", F.unix_millis(col(started_at)).cast("string"), col(user_id).cast("string"), F.concat(safe_name(name), F.lit(suffix)))


def suffix_route(path: Column | str, wav_exists: Column, packed: str = ".skopus") -> Column:
    """``ready``, ``decode`` or ``unsupported``, by the suffix in any case."""
    suffix = F.lower(F.regexp_extract(col(path), r"(?:^|/)[^/]+(\.[^./]+)$", 1))
    return F.when(suffix == ".wav", "ready").when(suffix != packed, "unsupported").when(wav_exists, "ready").otherwise("decode")


def wav_path(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"\.[^./]+$", ".wav")


def titled(note_type: Column | str, title: Column | str, content: Column | str) -> Column:
    """A note as it stands in a retrieval context."""
    return F.concat(F.lit("["), col(note_type), F.lit("] "), col(title), F.lit("\n"), col(content))


def embedding_text(note_type: Column | str, title: Column | str, content: Column | str) -> Column:
    return F.concat_ws("\n", col(note_type), col(title), col(content))


def summary_markdown(notes: Column | str, recap: Column | str) -> Column:
    return F.concat(F.lit("# Session Notes\n\n"), strip(notes), F.lit("\n\n# Cinematic Summary\n\n"), strip(recap), F.lit("\n"))


def completion_notice(session_id: Column | str, notes: Column | str, recap: Column | str, n_updates: Column | str) -> Column:
    n = col(n_updates)
    end = F.when(n > 0, F.concat(F.lit("\n\nUpdated "), n.cast("string"), F.lit(" campaign notes."))).otherwise("")
    return F.concat(F.lit("## Session "), col(session_id).cast("string"), F.lit("\n\n### Session Notes\n"), col(notes), F.lit("\n\n### Cinematic Summary\n"), col(recap), end)


def failure_notice(error: Column | str, opening: str = "Session processing failed: ") -> Column:
    return F.concat(F.lit(opening), F.substring(col(error), 1, ERROR_LIMIT))


def question_failure(error: Column | str) -> Column:
    return failure_notice(error, "Could not answer right now: ")


def answer_text(answer: Column | str) -> Column:
    return F.substring(col(answer), 1, MESSAGE_LIMIT)


def prompts(instructions: Column, attempt: Column | str, stage: Column | str, retry: str, final: str, context: Column | None = None) -> Column:
    """Instructions of a model call: a part for retries, one for the final
    stage, and optional project text. The wording is the caller's."""
    parts = [instructions, F.when(col(attempt) > 1, F.lit(retry)), F.when(col(stage) == "final", F.lit(final)), filled(context) if context is not None else F.lit(None)]
    return F.concat_ws("\n", *parts)


def transcript_prompt(transcript: Column | str) -> Column:
    return F.concat(F.lit(TRANSCRIPT_PROMPT), col(transcript))


def question_prompt(question: Column | str, context: Column | str) -> Column:
    return F.concat(F.lit("Question: "), col(question), F.lit("\n\nRelevant campaign notes:\n"), col(context))


def _parts(text: Column, pattern: str) -> Column:
    """What the pattern's first group takes, again and again, from the begin of
    the text to its end; without white space around, and without blank ones.
    Each step of the pattern takes at least a character."""
    found = F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(1))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def transcript_chunks(c: Column | str, single_pass: int = SINGLE_PASS_LIMIT, limit: int = CHUNK_LIMIT) -> Column:
    """Chunks of a transcript for a model. One within ``single_pass`` (or
    ``limit``) is one chunk, unchanged; else the heading's two lines go and
    whole lines fill chunks greedily, a line costing its length and one. The time
    is in proportion to the length."""
    text = col(c)
    # Every line ends with \n; two lines go if there are more.
    lines = F.concat(F.regexp_replace(F.regexp_replace(text, LINE_END, "\n"), r"\n\z", ""), F.lit("\n"))
    body = F.regexp_replace(lines, r"(?s)\A[^\n]*\n[^\n]*\n(?=.)", "")
    # As many characters as fit up to a line end, else one line.
    found = F.regexp_extract_all(body, F.lit(f"(?s)(.{{0,{limit - 1}}}\n|[^\n]*\n)"), F.lit(1))
    chunks = F.transform(found, lambda x: F.concat(F.lit(TRANSCRIPT_HEADING + "\n\n"), strip(x), F.lit("\n")))
    return F.when(F.length(text) <= max(single_pass, limit), F.array(text)).otherwise(chunks)


def message_pieces(c: Column | str, limit: int = MESSAGE_LIMIT) -> Column:
    """A message as pieces of at most ``limit`` characters. A short message stays
    as it is. Of a longer one, white space at the ends goes; a piece is the rest
    if that fits, else as much as fits before a blank line, else before a line
    end, else ``limit`` characters; white space between pieces goes."""
    text = col(c)
    # Possessive: what is longer than a piece does not end within it, however one looks back.
    ends = rf".{{1,{limit}}}+\z|.{{1,{limit - 2}}}(?=\n\n)|.{{1,{limit - 1}}}(?=\n)|.{{{limit}}}"
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(_parts(strip(text), f"({ends})[{WHITE_SPACE}]*"))
