"""Python-style patterns on Spark's regex functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from re import _parser

from tracewell.functions.sql import Sql, any_of, contains, let, struct, text

# Code points outside ASCII that ignoring case makes equal to an ASCII letter (long s,
# dotless i, dotted I, Kelvin sign). Lines without them may be searched in lower case.
FOLDS_TO_ASCII = "".join(map(chr, (0x17F, 0x131, 0x130, 0x212A)))
SHORTEST_GUARD = 2


# White space and word characters as Python's str has them.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CLASSES = {"DIGIT": (r"\p{Nd}", "0-9"), "SPACE": (SPACE, r"\t-\r\x{20}"), "WORD": (r"\p{L}\p{N}_", "a-zA-Z0-9_")}


JAVA_REPEATS = 2**31 - 2  # more have no form there


class Untranslatable(ValueError):
    """A pattern that Python knows and Spark's regex functions cannot say."""


class _Translation:
    """A parsed pattern in Java's spelling, written out from its tree: no text of it is taken over, so nothing in it
    can mean something else. Groups keep their order; empty ones mark what conditionals ask for."""

    def __init__(self, tree):
        self.referred = set()
        self._collect(tree)
        self.numbers: dict[int, int] = {}
        self.markers: dict[int, int] = {}
        self.groups = 0

    def _collect(self, tree) -> None:
        for op, arg in tree:
            if op is _parser.GROUPREF:
                self.referred.add(arg)
            elif op is _parser.GROUPREF_EXISTS:
                self.referred.add(arg[0])
                self._collect(arg[1])
                self._collect(arg[2] or ())
            elif op is _parser.BRANCH:
                for branch in arg[1]:
                    self._collect(branch)
            elif isinstance(arg, tuple) and arg and hasattr(arg[-1], "data"):
                self._collect(arg[-1])
            elif hasattr(arg, "data"):
                self._collect(arg)

    def group(self) -> int:
        self.groups += 1
        return self.groups

    def sequence(self, tree, flags: int, lead: bool = False) -> str:
        items = list(tree)
        out = ""
        if lead and items and (lookbehind := self._not_after(items[0], flags)):
            out, items = lookbehind, items[1:]
        return out + "".join(self.item(op, arg, flags) for op, arg in items)

    def _not_after(self, item, flags: int) -> str | None:
        """A leading ``(^|[^…])`` that nothing refers to asks what stands before the match; as the lookbehind it means,
        Java finds it up to ten times faster."""
        op, arg = item
        if op is not _parser.SUBPATTERN or arg[1] or arg[2] or arg[0] in self.referred or len(arg[3]) != 1:
            return None
        kind, branches = arg[3][0]
        if kind is not _parser.BRANCH or len(branches[1]) != 2 or any(len(b) != 1 for b in branches[1]):
            return None
        (first, where), (second, chars) = branches[1][0][0], branches[1][1][0]
        if first is not _parser.AT or where is not _parser.AT_BEGINNING or flags & re.MULTILINE:
            return None
        if second is _parser.NOT_LITERAL:
            negated = [(_parser.LITERAL, chars)]
        elif second is _parser.IN and chars[0][0] is _parser.NEGATE:
            negated = chars[1:]
        else:
            return None
        if arg[0] is not None:
            self.numbers[arg[0]] = self.group()
        return f"(?<!{self.chars(negated, flags)}){'()' if arg[0] is not None else ''}"

    def klass(self, name: str, flags: int) -> str:
        return CLASSES[name][bool(flags & re.ASCII)]

    def chars(self, items, flags: int) -> str:
        """A set as a choice of classes, each of them plain."""
        plain, other = "", []
        for op, arg in items:
            if op is _parser.LITERAL:
                plain += _code(arg)
            elif op is _parser.RANGE:
                plain += f"{_code(arg[0])}-{_code(arg[1])}"
            else:
                name = str(arg).removeprefix("CATEGORY_")
                if name.startswith("NOT_"):
                    other.append(f"[^{self.klass(name[4:], flags)}]")
                else:
                    plain += self.klass(name, flags)
        choices = ([f"[{plain}]"] if plain else []) + other
        return choices[0] if len(choices) == 1 else f"(?:{'|'.join(choices)})"

    def item(self, op, arg, flags: int) -> str:
        p = _parser
        if op is p.LITERAL:
            return _code(arg)
        if op is p.NOT_LITERAL:
            return f"[^{_code(arg)}]"
        if op is p.ANY:
            return "(?s:.)" if flags & re.DOTALL else r"[^\n]"
        if op is p.IN:
            if arg[0][0] is p.NEGATE:
                return f"(?:(?!{self.chars(arg[1:], flags)})(?s:.))"
            return self.chars(arg, flags)
        if op is p.AT:
            return self.place(str(arg), flags)
        if op is p.BRANCH:
            return f"(?:{'|'.join(self.sequence(b, flags) for b in arg[1])})"
        if op is p.SUBPATTERN:
            return self.subpattern(*arg, flags)
        if op in (p.MAX_REPEAT, p.MIN_REPEAT, p.POSSESSIVE_REPEAT):
            least, most, body = arg
            if least > JAVA_REPEATS or most is not p.MAXREPEAT and most > JAVA_REPEATS:
                raise Untranslatable("cannot translate so many repeats")
            how = "" if op is p.MAX_REPEAT else "?" if op is p.MIN_REPEAT else "+"
            return f"(?:{self.sequence(body, flags)}){{{least},{'' if most is p.MAXREPEAT else most}}}{how}"
        if op is p.GROUPREF and arg in self.numbers:
            return f"(?:\\{self.numbers[arg]})"
        if op is p.GROUPREF_EXISTS and arg[0] in self.markers:
            there = f"\\{self.markers[arg[0]]}"
            return f"(?:(?:{there}){self.sequence(arg[1], flags)}|(?!{there}){self.sequence(arg[2] or (), flags)})"
        if op in (p.ASSERT, p.ASSERT_NOT):
            sign = ("<" if arg[0] < 0 else "") + ("=" if op is p.ASSERT else "!")
            return f"(?{sign}{self.sequence(arg[1], flags)})"
        if op is p.ATOMIC_GROUP:
            return f"(?>{self.sequence(arg, flags)})"
        if op is p.FAILURE:
            return "(?!)"
        raise Untranslatable(f"cannot translate {str(op).lower()}")

    def place(self, where: str, flags: int) -> str:
        word = f"[{self.klass('WORD', flags)}]"
        if where == "AT_BEGINNING":
            return "(?m:^)" if flags & re.MULTILINE else r"\A"
        if where == "AT_END":
            return "(?m:$)" if flags & re.MULTILINE else r"(?=\n?\z)"
        if where == "AT_BEGINNING_STRING":
            return r"\A"
        if where == "AT_END_STRING":
            return r"\z"
        if where == "AT_BOUNDARY":
            return f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
        if where == "AT_NON_BOUNDARY":
            return rf"(?!\A\z)(?:(?<={word})(?={word})|(?<!{word})(?!{word}))"
        raise Untranslatable(f"cannot translate {where.lower()}")

    def subpattern(self, number, added: int, removed: int, body, flags: int) -> str:
        inner = (flags | added) & ~removed
        letters = _case_flags(inner)
        open_ = "(?:" if letters == _case_flags(flags) else f"(?{letters or '-iu'}:"
        if number is None:
            return f"{open_}{self.sequence(body, inner)})"
        self.numbers[number] = self.group()
        text_ = self.sequence(body, inner)
        if number in self.referred:
            self.markers[number] = self.group()
            text_ += "()"
        return f"({text_ if open_ == '(?:' else open_ + text_ + ')'})"


def _case_flags(flags: int) -> str:
    if not flags & re.IGNORECASE:
        return ""
    return "i-u" if flags & re.ASCII else "iu"


def _code(char: int) -> str:
    return chr(char) if char < 128 and chr(char).isalnum() else f"\\x{{{char:x}}}"


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """The same pattern for ``rlike``. Raises ``re.error`` where Python refuses it, ``Untranslatable`` where Java has
    nothing that means the same."""
    tree = _parser.parse(pattern, re.IGNORECASE if ignore_case else 0)
    flags = tree.state.flags
    letters = _case_flags(flags)
    body = _Translation(tree).sequence(tree, flags, lead=True)
    return f"(?d{letters}){body}" if "-" not in letters else f"(?d)(?{letters}){body}"


def check_pattern(pattern: str) -> str | None:
    """Why a pattern cannot be used, or None. What Python compiles can be used."""
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        return str(e)
    return None


def needs_python(pattern: str, ignore_case: bool = False) -> bool:
    """The pattern has no Java spelling."""
    try:
        java_pattern(pattern, ignore_case)
    except (Untranslatable, RecursionError):
        return True
    return False


def required_literals(pattern: str) -> tuple[str, ...]:
    """ASCII literals of which every match contains one; empty if no such set is known."""
    tree = _parser.parse(pattern)
    if tree.state.flags & ~re.UNICODE:
        return ()
    return _literals(tree)


def _literals(tree) -> tuple[str, ...]:
    found: list[tuple[str, ...]] = []
    run = ""
    for op, arg in [*tree, (None, None)]:
        if op is _parser.LITERAL and arg < 128:
            run += chr(arg)
            continue
        found.append((run,))
        run = ""
        if op is _parser.SUBPATTERN and not (arg[1] or arg[2]):
            found.append(_literals(arg[3]))
        elif op is _parser.BRANCH:
            branches = [_literals(b) for b in arg[1]]
            found.append(tuple(w for b in branches for w in b) if all(branches) else ())
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0] > 0:
            found.append(_literals(arg[2]))
    usable = [words for words in found if words and min(map(len, words)) >= SHORTEST_GUARD]
    return max(usable, key=lambda words: min(map(len, words)), default=())


def matches(line: "Line", pattern: str, ignore_case: bool = False) -> Sql:
    """The pattern is found in the line. Most lines lack every literal it needs and are settled by
    a byte search, without a Java string being made of them."""
    if needs_python(pattern, ignore_case):
        return line.found(pattern, ignore_case)
    test = f"rlike({line.text}, {text(java_pattern(pattern, ignore_case))})"
    guard = may_match(line, pattern, ignore_case)
    return test if guard is None else f"({guard} AND {test})"


def may_match(line: "Line", pattern: str, ignore_case: bool) -> Sql | None:
    """The line has a literal that every match contains; None if no such literal is known."""
    literals = required_literals(pattern)
    if not literals:
        return None
    if ignore_case:
        return any_of([*(contains(line.lower, w.lower()) for w in literals), line.folds])
    return any_of(contains(line.text, w) for w in literals)


def folds(c: Sql) -> Sql:
    """The text has a letter that equals an ASCII letter once case is ignored."""
    return f"(octet_length({c}) <> length({c}) AND {any_of(contains(c, ch) for ch in FOLDS_TO_ASCII)})"


class Line:
    """A line under test: its text, the same in lower case, whether ``folds`` holds, and, for patterns that need Python, how
    to look up what that found (``functions.python_regex``)."""

    def __init__(self, text: Sql, lower: Sql, folds: Sql, found: Callable[[str, bool], Sql] | None = None):
        self.text, self.lower, self.folds, self._found = text, lower, folds, found

    def found(self, pattern: str, ignore_case: bool) -> Sql:
        if self._found is None:
            raise Untranslatable(f"{pattern!r} has no Java spelling, and Python was not asked")
        return self._found(pattern, ignore_case)


def with_line(c: Sql, body, found: Callable[[str, bool], Sql] | None = None) -> Sql:
    """``body(Line)`` with the lower case of ``c`` made once."""
    return let(struct(lower=f"lower({c})", folds=folds(c)), lambda v: body(Line(c, f"{v}.lower", f"{v}.folds", found)))
