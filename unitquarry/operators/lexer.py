"""One linear pass over a JavaScript or TypeScript text: tokens with their brackets, functions, calls.

Small per-file helper of ``extract``: Spark spreads the files, each is read
once from left to right.  Positions are code points.  There is no syntax tree;
a function is told by its brackets and what stands around them, and type
annotations are stepped over by a reader of their own, so that function types
are not taken for functions.
"""

from __future__ import annotations

import re
from bisect import bisect_right

# Words of the language.
CONTROL = frozenset("if for while switch catch with".split())
KEYWORDS = frozenset(
    """if for while switch catch with function return typeof void delete in instanceof await yield throw case do else new super import class
    extends export default const let var break continue debugger enum finally try""".split())
BEFORE_VALUE = frozenset("return typeof void delete in of instanceof await yield throw case do else new extends default".split())
JOINS = frozenset("in of instanceof as satisfies extends implements is".split())
MODIFIERS = frozenset("async static public private protected readonly override abstract declare accessor get set".split())
TYPE_PREFIX = frozenset("keyof typeof readonly unique infer asserts new abstract out in const".split())

_LINE = re.compile("\r\n|[\n\r  ]")
_BLANK = re.compile(r"[\s﻿]+")
_WORD = re.compile(r"[#]?(?:[\w$]|[^\x00-\x7f\s  ]|\\u\{?[0-9a-fA-F]+\}?)+")
_NUMBER = re.compile(r"\.?\d(?:[eE][+-]|[\w.])*")
_STRING = {q: re.compile(rf"(?:[^{q}\\\n\r]|\\(?:\r\n|[\s\S]))*+{q}?") for q in "'\""}
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+")
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*+\])++/\w*")
_MARKS = re.compile(r"\.\.\.|=>|={1,3}|![=]{0,2}|\?\.(?!\d)|\?\?=?|&&=?|\|\|=?|\+\+|--|\*\*=?|<<=?|<=|[-+*/%&|^]=?|[^\w\s]")
_ELEMENT = re.compile(r"<(?:>|(?!\w+\s+extends\b)[A-Za-z_$][\w$.:-]*(?:\s*/?>|\s+[\w$:{/-]))")
_TAG_PART = re.compile(r"[^\"'{}/>]+")
PAIRS = {")": "(", "]": "[", "}": "{"}


class Reader:
    """Tokens of a text as parallel lists; ``match`` has the partner of a bracket, or the number of tokens if it has none."""

    def __init__(self, text: str, elements: bool) -> None:
        self.text, self.elements = text, elements
        self.tok: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.word: list[bool] = []
        self.up: list[int] = []
        self.match: dict[int, int] = {}
        self.level = self.lowest = 0
        self._open: list[int] = []
        self._read()
        n = len(self.tok)
        for i in self._open:
            self.match[i] = n
        self.typed: list[bool] = [False] * (n + 1)
        self.tok += ["", "", ""]
        self.word += [False] * 3

    # --- tokens

    def _add(self, tok: str, a: int, b: int, word: bool = False) -> None:
        i = len(self.tok)
        self.up.append(self._open[-1] if self._open else -1)
        self.tok.append(tok)
        self.start.append(a)
        self.end.append(b)
        self.word.append(word)
        if tok in ("(", "[", "{", "${", "<element"):
            self._open.append(i)
            self.level += tok != "<element"
        elif tok in (")", "]", "}", "element>"):
            self.level -= tok != "element>"
            self.lowest = min(self.lowest, self.level)
            wanted = ("<element",) if tok == "element>" else ("{", "${") if tok == "}" else (PAIRS[tok],)
            at = next((k for k in range(len(self._open) - 1, -1, -1) if self.tok[self._open[k]] in wanted), None)
            if at is not None:
                for lost in self._open[at + 1:]:
                    self.match[lost] = i
                self.match[self._open[at]], self.match[i] = i, self._open[at]
                self.up[i] = self._open[at - 1] if at else -1
                del self._open[at:]

    def _value_next(self) -> bool:
        """Whether a value may begin here, and a slash or an angle is no operator."""
        if not self.tok:
            return True
        i = len(self.tok) - 1
        last = self.tok[i]
        if self.word[i]:
            return last in BEFORE_VALUE and not (i and self.tok[i - 1] in (".", "?."))
        if last == ")":
            head = self.match.get(i, 0) - 1
            return head >= 0 and self.tok[head] in CONTROL and not (head and self.tok[head - 1] in (".", "?."))
        if last == "}":
            return self._is_block(self.match.get(i, 0))
        return last not in ("]", "element>", "++", "--", "`") and not last.startswith(("'", '"', "1"))

    def _is_block(self, i: int) -> bool:
        """Whether a brace opens statements, told by what stands before it."""
        if self.tok[i] != "{":
            return False
        before = self.tok[i - 1] if i else ""
        return before in ("", ")", "=>", ";", "{", "}", "else", "do", "try", "finally") or bool(i and self.word[i - 1] and before not in BEFORE_VALUE)

    def _read(self) -> None:
        text, at, n = self.text, 0, len(self.text)
        # What a closing brace returns to: "t" a template, "k" children of an element, "g" a tag, "j" plain code.
        modes: list[str] = []
        closers: list[bool] = []
        while at < n:
            mode = modes[-1] if modes else "j"
            c = text[at]
            if mode == "t":
                at = _TEMPLATE.match(text, at).end()
                if at >= n:
                    break
                if text[at] == "`":
                    modes.pop()
                    self._add("`", at, at + 1)
                    at += 1
                else:
                    self._add("${", at, at + 2)
                    modes.append("j")
                    at += 2
            elif mode == "k":
                if c == "<":
                    modes.append("g")
                    closers.append(text.startswith("</", at))
                    at += 2 if closers[-1] else 1
                elif c == "{":
                    self._add("{", at, at + 1)
                    modes.append("j")
                    at += 1
                else:
                    stops = [k for k in (text.find("<", at), text.find("{", at)) if k >= 0]
                    at = min(stops, default=n)
            elif mode == "g":
                if c in "'\"":
                    close = text.find(c, at + 1)
                    at = n if close < 0 else close + 1
                elif c == "{":
                    self._add("{", at, at + 1)
                    modes.append("j")
                    at += 1
                elif text.startswith("/>", at) or c == ">":
                    modes.pop()
                    ends = closers.pop()
                    empty = c == "/"
                    at += 2 if empty else 1
                    if not empty and not ends:
                        modes.append("k")
                    elif ends and modes and modes[-1] == "k":
                        modes.pop()
                    if (empty or ends) and not (modes and modes[-1] == "k"):
                        self._add("element>", at - 1, at)
                else:
                    m = _TAG_PART.match(text, at)
                    at = m.end() if m else at + 1
            elif c.isspace() or c == "﻿":
                at = _BLANK.match(text, at).end()
            elif text.startswith("//", at):
                m = _LINE.search(text, at)
                at = m.start() if m else n
            elif text.startswith("/*", at):
                close = text.find("*/", at + 2)
                at = n if close < 0 else close + 2
            elif c in "'\"":
                b = _STRING[c].match(text, at + 1).end()
                self._add(text[at:b], at, b)
                at = b
            elif c == "`":
                self._add("`", at, at + 1)
                modes.append("t")
                at += 1
            elif c == "/" and self._value_next() and (m := _REGEX.match(text, at)):
                self._add("1regex", at, m.end())
                at = m.end()
            elif c == "<" and self.elements and self._value_next() and _ELEMENT.match(text, at):
                self._add("<element", at, at + 1)
                modes.append("g")
                closers.append(False)
                at += 1
            elif c.isdigit() or c == "." and text[at + 1:at + 2].isdigit():
                m = _NUMBER.match(text, at)
                b = m.end() if m else at + 1
                self._add("1" + text[at:b], at, b)
                at = b
            elif (m := _WORD.match(text, at)) and m.end() > at:
                self._add(m.group(), at, m.end(), True)
                at = m.end()
            else:
                m = _MARKS.match(text, at)
                b = m.end() if m else at + 1
                tok = text[at:b]
                self._add(tok, at, b)
                if modes and mode == "j":
                    if tok == "{":
                        modes.append("j")
                    elif tok == "}":
                        modes.pop()
                at = b

    # --- types

    def type_end(self, i: int, depth: int = 0) -> int:
        """Index after the type that begins at token ``i``."""
        tok, n = self.tok, len(self.start)
        while i < n and depth < 200:
            while i < n and (tok[i] in TYPE_PREFIX or tok[i] in ("|", "&", "-")):
                i += 1
            if tok[i] == "<":
                after = self.angle_end(i, depth + 1)
                if after < 0:
                    return i
                i = after
            if tok[i] == "(":
                i = self.match.get(i, n) + 1
                if tok[min(i, n)] == "=>":
                    i += 1
                    continue
            elif tok[i] in ("{", "["):
                i = self.match.get(i, n) + 1
            elif tok[i] == "`":
                i += 1
                while i < n and tok[i] != "`":
                    i = self.match.get(i, i) + 1
                i += 1
            elif i < n and (self.word[i] or tok[i][0] in "'\"1"):
                i += 1
                while tok[min(i, n)] == "." and self.word[min(i + 1, n)]:
                    i += 2
                if tok[min(i, n)] == "(" and tok[i - 1] == "import":
                    i = self.match.get(i, n) + 1
                if tok[min(i, n)] == "<" and (after := self.angle_end(i, depth + 1)) >= 0:
                    i = after
            else:
                return i
            while i < n and tok[i] == "[" and not self.new_line(i):
                i = self.match.get(i, n) + 1
            i = min(i, n)
            if tok[i] in ("|", "&", "is"):
                i += 1
            elif tok[i] == "extends":
                i = self.type_end(i + 1, depth + 1)
                if tok[min(i, n)] != "?":
                    return i
                i = self.type_end(i + 1, depth + 1)
                if tok[min(i, n)] != ":":
                    return i
                i += 1
            else:
                return i
        return min(i, n)

    def angle_end(self, i: int, depth: int = 0) -> int:
        """Index after the type arguments or parameters that begin at ``i``; -1 if it is a comparison."""
        n = len(self.start)
        i += 1
        while i < n and depth < 200:
            if self.tok[i] == ">":
                return i + 1
            after = self.type_end(i, depth + 1)
            if self.tok[min(after, n)] == "=":
                after = self.type_end(after + 1, depth + 1)
            if after == i:
                return -1
            i = after
            if self.tok[min(i, n)] == ",":
                i += 1
            elif self.tok[min(i, n)] != ">":
                return -1
        return -1

    def mark(self, a: int, b: int) -> None:
        for i in range(a, min(b, len(self.start))):
            self.typed[i] = True

    def new_line(self, i: int) -> bool:
        return i > 0 and _LINE.search(self.text, self.end[i - 1], self.start[i]) is not None


class Function:
    __slots__ = ("name", "kind", "owner", "start", "end")

    def __init__(self, name: str, kind: str, owner: str | None, start: int, end: int) -> None:
        self.name, self.kind, self.owner, self.start, self.end = name, kind, owner, start, end


class Outline:
    """Functions and calls of a text."""

    def __init__(self, text: str, elements: bool = True) -> None:
        self.r = r = Reader(text, elements)
        self.n = len(r.start)
        self.functions: list[Function] = []
        self.calls: list[tuple[str, str | None, int]] = []
        # Brackets that are heads of functions, bodies of classes, and types' closing angles with their opening ones.
        self.heads: set[int] = set()
        self.classes: dict[int, str] = {}
        self.angles: dict[int, int] = {}
        self._class_ends: list[tuple[int, str]] = []
        for i in range(self.n):
            while self._class_ends and i > self._class_ends[-1][0]:
                self._class_ends.pop()
            if not r.typed[i]:
                self._at(i)
        self.functions.sort(key=lambda f: (f.start, -f.end))

    def _tok(self, i: int) -> str:
        return self.r.tok[i] if 0 <= i < self.n else ""

    def _at(self, i: int) -> None:
        r, tok = self.r, self.r.tok[i]
        if r.word[i] and self._tok(i - 1) not in (".", "?."):
            after = self._tok(i + 1)
            if tok == "class" and (r.word[i + 1] or after == "{"):
                self._class(i)
            elif tok == "interface" and r.word[i + 1] and not r.new_line(i + 1):
                body = next((k for k in range(i + 1, self.n) if r.tok[k] == "{" and r.up[k] == r.up[i]), self.n)
                r.mark(i + 1, r.match.get(body, self.n) + 1)
            elif tok == "type" and r.word[i + 1] and self._tok(i + 2) in ("=", "<") and not r.new_line(i + 1):
                equals = i + 2 if self._tok(i + 2) == "=" else max(r.angle_end(i + 2), i + 2)
                if self._tok(equals) == "=":
                    r.mark(i + 2, r.type_end(equals + 1))
            elif tok in ("as", "satisfies") and i and (r.word[i + 1] or after in ("{", "[", "(")) and not r.new_line(i) and self._ends_value(i - 1):
                r.mark(i + 1, r.type_end(i + 1))
            elif tok in ("const", "let", "var"):
                self._declared(i + 1)
            elif tok == "function" and after not in (":", "=", ",", ")", "}"):
                self._function(i)
        if tok == "," and r.up[i] == self._declaring:
            self._declared(i + 1)
        elif tok == ";" and r.up[i] == self._declaring:
            self._declaring = -2
        if tok == "<" and i and r.word[i - 1]:
            after = r.angle_end(i)
            if after > 0 and self._tok(after) in ("(", "`"):
                self.angles[after - 1] = i
                r.mark(i, after)
        elif tok == "<" and r.angle_end(i) > 0 and self._tok(r.angle_end(i)) == "(":
            self.angles[r.angle_end(i) - 1] = i
            r.mark(i, r.angle_end(i))
        if tok == "(":
            self._bracket(i)
        elif tok == "=>" and i and r.word[i - 1] and not r.typed[i - 1] and self._tok(i - 2) not in (".", "?."):
            first = i - 1
            if self._tok(first - 1) == "async" and not r.new_line(first):
                first -= 1
            self._arrow(first, i)
        elif tok == ":" and i and self.classes.get(r.up[i]) is not None and self._is_member(i - 1):
            r.mark(i + 1, r.type_end(i + 1))

    _declaring = -2

    def _declared(self, i: int) -> None:
        """A variable may carry its type after its name or pattern."""
        r = self.r
        self._declaring = r.up[i - 1] if i else -2
        after = r.match.get(i, i) + 1 if self._tok(i) in ("{", "[") else i + 1
        if self._tok(after) == "!":
            after += 1
        if self._tok(after) == ":":
            r.mark(after + 1, r.type_end(after + 1))

    def _ends_value(self, i: int) -> bool:
        return self.r.word[i] and self._tok(i) not in BEFORE_VALUE or self._tok(i) in (")", "]", "}", "`", "!") or self._tok(i)[:1] in "'\"1"

    def _is_member(self, i: int) -> bool:
        """Whether the token ends the name of a property of a class: nothing but modifiers up to the last member."""
        r = self.r
        if self._tok(i) in ("?", "!"):
            i -= 1
        first = r.match.get(i, i) if self._tok(i) == "]" else i
        before = self._tok(first - 1)
        return before in ("{", "}", ";", ")") or before in MODIFIERS or r.new_line(first)

    def _class(self, i: int) -> None:
        r = self.r
        name = self._tok(i + 1) if r.word[i + 1] and self._tok(i + 1) not in ("extends", "implements") else "<anonymous class>"
        k = i + 1
        while k < self.n and r.tok[k] != "{":
            if r.tok[k] == "<" and (after := r.angle_end(k)) > 0:
                r.mark(k, after)
                k = after
            else:
                k = r.match.get(k, k) + 1
        if k < self.n:
            self.classes[k] = name
            self._class_ends.append((r.match.get(k, self.n), name))

    def _params(self, o: int) -> None:
        """Types in a list of parameters are no code."""
        r, close = self.r, self.r.match.get(o, self.n)
        self.heads.add(o)
        i = o + 1
        while i < close:
            if r.tok[i] == ":" and r.up[i] == o:
                after = r.type_end(i + 1)
                r.mark(i + 1, after)
                i = max(after, i + 1)
            elif r.tok[i] == "=" and r.up[i] == o:
                # A default value is code: on to the next parameter.
                while i < close and not (r.tok[i] == "," and r.up[i] == o):
                    i += 1
            else:
                i = r.match.get(i, i) + 1 if r.tok[i] in ("(", "[", "{") else i + 1

    def _body(self, close: int) -> int:
        """Opening brace of the body after a head, stepping over the type of the result; -1 without a body."""
        after = close + 1
        if self._tok(after) == ":":
            end = self.r.type_end(after + 1)
            if self._tok(end) == "{":
                self.r.mark(after + 1, end)
                return end
            return -1
        return after if self._tok(after) == "{" else -1

    def _end_of(self, brace: int) -> int:
        close = self.r.match.get(brace, self.n)
        return self.r.end[close] if close < self.n else len(self.r.text)

    def _add(self, name: str, kind: str, first: int, end: int) -> None:
        self.functions.append(Function(name, kind, self._class_ends[-1][1] if self._class_ends else None, self.r.start[first], end))

    def _function(self, i: int) -> None:
        r, k = self.r, i + 1
        if self._tok(k) == "*":
            k += 1
        name = None
        if r.word[k]:
            name = self._tok(k)
            k += 1
        if self._tok(k) == "<" and (after := r.angle_end(k)) > 0:
            r.mark(k, after)
            k = after
        if self._tok(k) != "(":
            return
        self._params(k)
        body = self._body(r.match.get(k, self.n))
        if body < 0:
            if self._tok(r.match.get(k, self.n) + 1) == ":":
                r.mark(r.match.get(k, self.n) + 2, r.type_end(r.match.get(k, self.n) + 2))
            return
        first = i - 1 if self._tok(i - 1) == "async" else i
        value = first
        while self._tok(first - 1) in ("export", "default", "declare"):
            first -= 1
        self._add(name or self._assigned(value) or "<anonymous>", "function", first, self._end_of(body))

    def _bracket(self, o: int) -> None:
        r = self.r
        close = r.match.get(o, self.n)
        before = o - 1
        if before in self.angles:
            before = self.angles[before] - 1
        # Arrow functions.
        if o not in self.heads and not (before >= 0 and self._ends_value(before) and self._tok(before) not in ("async", "}")):
            arrow = close + 1
            if self._tok(arrow) == ":" and self._tok(before) != "?":
                arrow = r.type_end(close + 2)
            if self._tok(arrow) == "=>":
                if arrow > close + 1:
                    r.mark(close + 2, arrow)
                self._params(o)
                first = before + 1
                if self._tok(before) == "async" and self._tok(before - 1) not in (".", "?."):
                    first -= 1
                self._arrow(first, arrow)
                return
        if o not in self.heads and not self._method(o, before, close):
            self._call(o, before)

    def _method(self, o: int, before: int, close: int) -> bool:
        """Whether the bracket is the head of a method or a signature, which is noted if it has a body."""
        r = self.r
        brace = r.up[o]
        in_class = brace in self.classes
        optional = self._tok(before) in ("?", "!")
        last = before - optional
        if last < 0 or not (brace < 0 or r.tok[brace] == "{") or brace in r.match and not in_class and brace >= 0 and r._is_block(brace):
            return False
        if r.word[last]:
            first, name = last, r.tok[last]
        elif r.tok[last][:1] in "'\"":
            first, name = last, r.tok[last][1:-1]
        elif r.tok[last].startswith("1"):
            first, name = last, r.tok[last][1:]
        elif r.tok[last] == "]" and r.match.get(last, -1) > brace:
            first = r.match[last]
            name = r.text[r.start[first]:r.end[last]]
        else:
            return False
        lead = self._tok(first - 1)
        if lead in (".", "?.", "new", "@", "function") or name in CONTROL and not in_class or self._tok(last) == "]" and r.word[first - 1] and not lead in MODIFIERS:
            return False
        fits = lead in ("", "{", "}", ";", ",", "*", ")") or lead in MODIFIERS or r.new_line(first)
        if not fits or name == "super":
            return False
        body = self._body(close)
        if body < 0:
            # A signature: in a class whatever ends it, elsewhere only with the type of its result.
            signature = in_class and (self._tok(close + 1) in (":", ";", "}", "") or r.new_line(close + 1)) and lead != ")"
            if signature:
                self._params(o)
                if self._tok(close + 1) == ":":
                    r.mark(close + 2, r.type_end(close + 2))
            return signature
        if brace < 0:
            self._params(o)
            return True
        self._params(o)
        while first > 0 and (r.tok[first - 1] == "*" or r.tok[first - 1] in MODIFIERS and r.up[first - 1] == brace):
            first -= 1
        if in_class:
            first = self._decorated(first)
        self._add(name, "method", first, self._end_of(body))
        return True

    def _decorated(self, first: int) -> int:
        """First token of the decorators in front of a member."""
        r = self.r
        while first > 1:
            k = first - 1
            if r.tok[k] == ")":
                k = r.match.get(k, 0) - 1
            while k > 1 and r.word[k] and r.tok[k - 1] == ".":
                k -= 2
            if k < 1 or not r.word[k] or r.tok[k - 1] != "@":
                break
            first = k - 1
        return first

    def _arrow(self, first: int, arrow: int) -> None:
        r = self.r
        if self._class_ends and self.classes.get(r.up[first]) is not None and self._tok(first - 1) == ":":
            return
        body = arrow + 1
        if self._tok(body) == "{":
            end = self._end_of(body)
        else:
            end = self._expression_end(body, r.up[arrow])
        self._add(self._assigned(first) or "<anonymous>", "arrow", first, end)

    def _expression_end(self, i: int, up: int) -> int:
        """Offset after the expression that begins at token ``i``."""
        r, asked, first = self.r, 0, i
        stop = r.match.get(up, self.n) if up >= 0 else self.n
        while i < stop:
            t = r.tok[i]
            if t in (",", ";") or t == ":" and not asked:
                break
            if i > first and r.new_line(i) and self._ends_value(i - 1) and (r.word[i] and t not in JOINS or t in ("{", "@", "`") or t[:1] in "'\"1" or t in ("++", "--")):
                break
            asked += (t == "?") - (t == ":")
            i = r.match.get(i, i) + 1 if t in ("(", "[", "{", "<element") else self._template_end(i) if t == "`" else i + 1
        i = min(i, stop)
        return r.end[i - 1] if i > first else r.start[first] if first < self.n else len(r.text)

    def _template_end(self, i: int) -> int:
        i += 1
        while i < self.n and self.r.tok[i] != "`":
            i = self.r.match.get(i, i) + 1
        return i + 1

    def _assigned(self, first: int) -> str | None:
        """Name of the variable, property or target that a function value is given to."""
        r, p = self.r, first - 1
        before = self._tok(p)
        if before == "default" and self._tok(p - 1) == "export":
            return "default"
        up = r.up[p] if p >= 0 else -1
        if before == ":" and up >= 0 and r.tok[up] == "{" and up not in self.classes:
            k = r.match.get(p - 1, p - 1) if self._tok(p - 1) == "]" else p - 1
            if self._tok(k - 1) not in ("{", ","):
                return None
            name = self._tok(p - 1)
            return name[1:-1] if name[:1] in "'\"" else name[1:] if name.startswith("1") else r.text[r.start[k]:r.end[p - 1]]
        if before != "=" or up in self.heads or up in self.classes:
            return None
        if self._tok(p - 1) == "export":
            return "default"
        # Back to the start of the target; types are stepped over.
        k = p - 1
        while k >= 0 and r.typed[k]:
            k -= 1
        if k >= 0 and r.tok[k] == ":" and k < p - 1:
            k -= 1
        k -= self._tok(k) == "!" and k < p - 1
        last = k
        while k >= 0:
            if r.tok[k] in (")", "]", "}") and k in r.match:
                k = r.match[k]
                if r.tok[k] in ("{",) or k == 0 or not self._ends_value(k - 1) or r.new_line(k):
                    break
                k -= 1
            elif k and r.tok[k - 1] in (".", "?."):
                k -= 2
            else:
                break
        if k < 0:
            return None
        if up >= 0 and r.tok[up] == "{" and not r._is_block(up) and self._tok(k - 1) in ("{", ","):
            return None
        return r.text[r.start[k]:r.end[last]]

    def _call(self, o: int, before: int) -> None:
        r = self.r
        if self._tok(before) == "?.":
            before -= 1
        if before < 0 or not r.word[before] or r.typed[o]:
            return
        name, lead = r.tok[before], self._tok(before - 1)
        dotted = lead in (".", "?.")
        receiver = None
        if dotted:
            k = before
            while k > 1 and r.tok[k - 1] in (".", "?.") and r.word[k - 2]:
                k -= 2
            if self._tok(k - 1) == "new" and self._tok(k - 2) != ".":
                return
            held = before - 2
            if held >= 0 and r.word[held] and self._tok(held - 1) not in (".", "?.") and r.tok[held] not in KEYWORDS:
                receiver = r.tok[held]
        elif name in KEYWORDS or name in ("this", "async") and name == "this" or lead in ("new", "function") or lead == "*" and self._tok(before - 2) == "function":
            return
        self.calls.append((name, receiver, r.start[o]))


def line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in _LINE.finditer(text))]


def line_of(starts: list[int], at: int) -> int:
    return bisect_right(starts, at)
