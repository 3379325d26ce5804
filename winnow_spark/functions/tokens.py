"""Token accounting as column expressions: estimate, flag, truncation and chunking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4
MARKER = "\n… [truncated]"
NO_SYMBOLS = r"[A-Za-z0-9_\s]+"
BLANK_RUN = r"[ \t]{2,}"

#: A counter maps a text column to its number of tokens.
Counter = Callable[[Column], Column]


def _counts(text: Column) -> tuple[Column, Column, Column]:
    """Characters, symbols and runs of blanks. Symbols are what is left without the rest: counting their matches takes many times longer."""
    return F.length(text), F.length(F.regexp_replace(text, NO_SYMBOLS, "")), F.regexp_count(text, F.lit(BLANK_RUN))


def _estimate(chars: Column, symbols: Column, runs: Column) -> Column:
    weight = chars / F.lit(4.0) + symbols * F.lit(0.25) - runs * F.lit(0.1)
    return F.when(F.coalesce(chars, F.lit(0)) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(weight))).cast("long")


def estimate_tokens(text: Column) -> Column:
    """A quarter token a character, another quarter a symbol, less a tenth per run of blanks; at least 1, and 0 for null or empty."""
    return _estimate(*_counts(text))


def is_reliable_estimate(text: Column) -> Column:
    return estimate_tokens(text) > 0


def count_tokens(text: Column, counter: Counter | None = None) -> Column:
    """Tokens by ``counter``, else the estimate."""
    if counter is not None and not callable(counter):
        raise TypeError("an exact counter is a function of a text column, or None")
    return (counter or estimate_tokens)(text)


def counter_kind(counter: Counter | None = None) -> str:
    return "estimated" if counter is None else "exact"


def was_truncated(text: Column, limit: Column | int, counter: Counter | None = None) -> Column:
    return F.coalesce(count_tokens(text, counter) > limit, F.lit(False))


def truncate_to_tokens(text: Column, limit: Column | int, marker: str = MARKER, counter: Counter | None = None) -> Column:
    """Text that fits is unchanged; other text is cut to about ``limit`` tokens, after a newline in its last fifth if there is one, and marked."""
    limit = F.lit(limit) if not isinstance(limit, Column) else limit
    room = F.greatest(F.lit(1), F.floor(limit * CHARS_PER_TOKEN)) - count_tokens(F.lit(marker), counter) * CHARS_PER_TOKEN
    target = F.greatest(F.lit(1), room).cast("int")
    cut = F.substring(text, F.lit(1), target)
    from_end = F.instr(F.reverse(cut), "\n")  # 1 where the cut ends in a newline
    after_newline = F.length(cut) - from_end + 1
    late = (from_end > 0) & (after_newline - 1 >= F.floor(target * F.lit(0.8)))
    shortened = F.when(late, F.substring(cut, F.lit(1), after_newline.cast("int"))).otherwise(cut)
    return F.when(was_truncated(text, limit, counter), F.concat(shortened, F.lit(marker))).otherwise(F.coalesce(text, F.lit("")))


def _packed(text: Column, limit: Column | int) -> Column:
    """The chunks by the estimate, whose counts add up over lines: each line is measured once, not once for every line that joins it."""
    # Bound by lambdas, so that lines and starts are evaluated once a row.
    return F.transform(F.array(F.split(text, "\n")), lambda lines: F.transform(F.array(_starts(lines, limit)), lambda starts: _joined(lines, starts))[0])[0]


def _starts(lines: Column, limit: Column | int) -> Column:
    """At which lines (from 0) chunks begin."""
    names = ("chars", "symbols", "runs")
    sizes = F.transform(lines, lambda line: F.struct(*[c.alias(n) for n, c in zip(names, _counts(line))]))
    zero = F.lit(0)
    start = F.struct(F.array().cast("array<int>").alias("starts"), zero.alias("at"), *[zero.alias(n) for n in names])

    def add(state: Column, line: Column) -> Column:
        first = state["at"] == 0
        grown = [state["chars"] + F.when(first, 0).otherwise(1) + line["chars"], state["symbols"] + line["symbols"], state["runs"] + line["runs"]]  # a newline joins them
        opens = first | (_estimate(*grown) > limit)
        starts = F.when(opens, F.concat(state["starts"], F.array(state["at"]))).otherwise(state["starts"])
        return F.struct(starts.alias("starts"), (state["at"] + 1).alias("at"), *[F.when(opens, line[n]).otherwise(g).alias(n) for n, g in zip(names, grown)])

    return F.aggregate(sizes, start, add, lambda s: s["starts"])


def _joined(lines: Column, starts: Column) -> Column:
    end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(lines))
    return F.transform(starts, lambda at, k: F.array_join(F.slice(lines, at + 1, end(k) - at), "\n"))


def _packed_by_counter(text: Column, limit: Column | int, counter: Counter) -> Column:
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("current"))

    def add(state: Column, line: Column) -> Column:
        joined = F.when(state["current"].isNull(), line).otherwise(F.concat(state["current"], F.lit("\n"), line))
        full = count_tokens(joined, counter) > limit
        closed = F.when(full & state["current"].isNotNull(), F.concat(state["done"], F.array(state["current"]))).otherwise(state["done"])
        return F.struct(closed.alias("done"), F.when(full, line).otherwise(joined).alias("current"))

    return F.aggregate(F.split(text, "\n"), start, add, lambda s: F.when(s["current"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["current"]))))


def chunk_to_tokens(text: Column, limit: Column | int, counter: Counter | None = None) -> Column:
    """Chunks of whole lines that fit ``limit`` each; a longer line is a chunk of its own; no chunks for empty text."""
    packed = _packed_by_counter(text, limit, counter) if counter is not None else _packed(text, limit)
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, empty).when(count_tokens(text, counter) <= limit, F.array(text)).otherwise(packed)
