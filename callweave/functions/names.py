"""Name rules, filters and similarity as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.wordlists import IGNORED_PARTS, OPERATORS, RULES
from callweave.schema import UNKNOWN

Rule = Callable[[Column], Column]


def operator_words(c: Column) -> Column:
    """Spell the first ``operator`` symbol and drop what follows it.

    The first listed symbol that begins the text after the first ``operator``
    counts; a name without one stays.
    """
    word = "operator"
    at = F.instr(c, word)
    rest = F.substring(c, at + len(word), F.length(c))
    head = F.substring(c, F.lit(1), at + (len(word) - 1))
    symbol = reduce(lambda a, x: a.when(F.startswith(rest, F.lit(x[0])), F.lit(x[1])), OPERATORS[1:], F.when(F.startswith(rest, F.lit(OPERATORS[0][0])), F.lit(OPERATORS[0][1])))
    return F.when((at > 0) & symbol.isNotNull(), F.concat(head, F.lit("_"), symbol)).otherwise(c)


@dataclass
class RuleSet:
    """Ordered rewriting rules. Order is meaning: each sees what the ones before left."""

    rules: list[Rule] = field(default_factory=list)

    def literal(self, old: str, new: str) -> RuleSet:
        """Replace all of ``old``, left to right, once."""
        if not old:
            raise ValueError("an empty text can't be replaced")
        self.rules.append(lambda c: F.replace(c, F.lit(old), F.lit(new)))
        return self

    def regex(self, pattern: str, new: str) -> RuleSet:
        """Replace all matches; ``$1`` stands for a group."""
        self.rules.append(lambda c: F.regexp_replace(c, pattern, new))
        return self

    def column_fn(self, rule: Rule) -> RuleSet:
        self.rules.append(rule)
        return self

    def apply(self, c: Column) -> Column:
        return reduce(lambda x, rule: rule(x), self.rules, c)


def rule_set(rules: Iterable[tuple[bool, str, str]] = RULES, operators: bool = True) -> RuleSet:
    """Rules from (is a regular expression, from, to), then the operator rule."""
    out = RuleSet()
    for is_regex, old, new in rules:
        (out.regex if is_regex else out.literal)(old, new)
    return out.column_fn(operator_words) if operators else out


@dataclass(frozen=True)
class NameFilter:
    """Whether a name is one of ``exact`` or holds one of ``partial``."""

    exact: tuple[str, ...] = ()
    partial: tuple[str, ...] = IGNORED_PARTS

    def matches(self, c: Column) -> Column:
        # a part that holds another part adds nothing
        least = [p for p in self.partial if not any(q != p and q in p for q in self.partial)]
        tests = [F.contains(c, F.lit(p)) for p in dict.fromkeys(least)]
        if self.exact:
            tests.append(c.isin(*self.exact))
        return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_unknown(c: Column) -> Column:
    return F.startswith(c, F.lit(UNKNOWN))


def without_prefix(c: Column) -> Column:
    """A name without one leading ``FUN_``."""
    return F.regexp_replace(c, f"^{UNKNOWN}", "")


def as_bytes(c: Column) -> Column:
    """A text with a character for each UTF-8 byte, so lengths and distances count bytes."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def name_similarity(a: Column, b: Column, least: float) -> Column:
    """1 - edit distance / longer length, or 0 for an empty name or lengths too far apart for ``least``."""
    a, b = as_bytes(a), as_bytes(b)
    long, short = F.greatest(F.length(a), F.length(b)).cast("double"), F.least(F.length(a), F.length(b)).cast("double")
    none = (short == 0) | (1.0 - (long - short) / long < least)
    return F.when(none, 0.0).otherwise(1.0 - F.levenshtein(a, b) / long)


def class_of(c: Column) -> Column:
    """What stands before the first ``::``, or a name for no class."""
    return F.when(F.instr(c, "::") > 0, F.substring_index(c, "::", 1)).otherwise(F.lit("unnamed namespace"))


def qualified_name(namespaces: Column, name: Column) -> Column:
    """Namespaces, outermost first, and a name, joined by ``::``."""
    return F.concat_ws("::", namespaces, name)


def is_renamed(source: Column, name: Column) -> Column:
    """Whether a name was given by a user or an import, or by an analysis that didn't make it up."""
    made_up = F.startswith(name, F.lit(UNKNOWN)) | F.startswith(name, F.lit("thunk_"))
    return source.isin("USER_DEFINED", "IMPORTED") | ((source == "ANALYSIS") & ~made_up)
