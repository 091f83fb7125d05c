"""One pass over the tokens of a PHP text: its declarations, and the places where names stand.

``scan`` is the helper that tasks call for each file. It knows comments, strings with
interpolation, heredocs, attributes and brackets, and keeps a stack of open scopes; it builds
no syntax tree. Each step costs the same wherever in the text it stands.
"""

from __future__ import annotations

import bisect
import json
import re
from dataclasses import dataclass, field

# Every character is in a token or in white space between two, so that lengths tell where tokens stand.
# What most tokens are stands first; these begin with no character that a later one begins with.
_TOKEN = re.compile(
    r"""(\s++
    |\\?[^\W\d]\w*+(?:\\[^\W\d]\w*+)*+
    |[()\[\]{},;]|::|->|=>|\.\.\.|\?->|\#\[|[^\s\w/\#<'"$\\?]
    |\$+[^\W\d]\w*+
    |'(?>\\.|[^'\\])*+(?:'|\Z)|"(?>\\.|\{\$[^{}"]*+(?>"[^"]*+"[^{}"]*+)*+\}|[^"\\])*+(?:"|\Z)
    |\d[\w.]*+
    |/\*.*?(?:\*/|\Z)|//(?:(?!\?>)[^\n])*+|\#(?!\[)(?:(?!\?>)[^\n])*+
    |<<<[ \t]*(?P<quote>["']?)(?P<label>[A-Za-z_]\w*)(?P=quote)[ \t]*\r?\n(?:.*?\n)??(?:[ \t]*(?P=label)\b|\Z)
    |\?>.*?(?:<\?(?:php\b|=)|\Z)
    |[^\s\w])""",
    re.S | re.X,
)
_OPENING = re.compile(r"<\?(?:php\b|=)")
#: Kinds of tokens that their first character tells; None where that doesn't do.
_KINDS = dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_", "name") | dict.fromkeys(" \t\r\n", "") | dict.fromkeys("()[]{},;:-=>.!&|+*@^~%`", "op")
#: Words that are followed by a parenthesis without being called.
_NO_CALL = frozenset("and array as catch declare die do echo else elseif empty eval exit fn for foreach function global if include include_once isset list match new or print require require_once return static switch unset use while xor yield".split())
_MODIFIERS = frozenset("abstract final private protected public readonly static var".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "#[": "]"}, frozenset(")]}")
#: Operators and names that a reader looks at for more than what they stand beside.
_MARKS = frozenset([*_OPEN, *_CLOSE, ";"])
_DECLARING = frozenset("namespace class interface trait enum function const global".split())
_NO_NAME = _NO_CALL | _MODIFIERS


@dataclass
class Scan:
    """Declarations (dicts with start, end in characters) and places (kind, literal, start, end, arguments)."""

    symbols: list[dict] = field(default_factory=list)
    places: list[tuple] = field(default_factory=list)


def tokens(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, text) of every token of the PHP parts, comments among them; all of a text without an open tag."""
    opening = _OPENING.search(text)
    end, found, kinds = opening.end() if opening else 0, [], _KINDS
    for t, _, label in _TOKEN.findall(text, end):
        start = end
        end += len(t)
        kind = kinds.get(t[0])
        if kind is None:
            kind = _kind(t, label, end == len(text))
        if kind:
            found.append((kind, start, end, t))
    return found


def _kind(t: str, label: str, last: bool) -> str:
    """The kind of a token, by more than its first character; nothing for white space. A lone quote is a string where it is the last."""
    first = t[0]
    if first in "'\"":
        return "string" if len(t) > 1 or last else "op"
    if label:
        return "heredoc"
    if len(t) > 1:
        if first == "/":
            return "doc" if t.startswith("/**") and t[3:4] != "/" else "comment"
        if first == "#":
            return "op" if t == "#[" else "comment"
        if first == "$":
            return "op" if t[-1] == "$" else "var"
        if first == "?":
            return "op" if t == "?->" else "outside"
    elif first == "#":
        return "comment"
    if first.isspace():
        return ""
    if first.isdecimal():
        return "number"
    return "name" if len(t) > 1 or re.match(r"\w", t) else "op"


def brackets(code: list[tuple]) -> dict[int, tuple[int, int]]:
    """For each opening bracket's index the index of its partner and the top-level items between them."""
    found, stack = {}, []
    for k, (kind, _, _, t) in enumerate(code):
        if kind != "op":
            if stack:
                stack[-1][2] = True
        elif t in _OPEN:
            if stack:
                stack[-1][2] = True
            stack.append([k, 0, False])
        elif not stack:
            continue
        elif t in _CLOSE:
            at, commas, some = stack.pop()
            found[at] = (k, commas + (1 if some and code[k - 1][3] != "," else 0))
        elif t == ",":
            stack[-1][1] += 1
        else:
            stack[-1][2] = True
    for at, commas, some in stack:
        found[at] = (len(code), commas + (1 if some else 0))
    return found


def scan(path: str, text: str, package: str = r"\w+") -> Scan:
    """Declarations and places of one text; what is cut off ends with the text."""
    code, docs, doc = [], {}, None
    for token in tokens(text):
        kind = token[0]
        if kind == "doc":
            doc = token[3]
        elif kind != "comment" and kind != "outside":
            if doc is not None:
                docs[len(code)] = doc
                doc = None
            code.append(token)
    return _Reader(path, text, code, docs, package).read()


class _Reader:
    def __init__(self, path: str, text: str, code: list[tuple], docs: dict[int, str], package: str):
        self.path, self.text, self.code, self.docs, self.package = path, text, code, docs, package
        self.pairs = brackets(code)
        self.out = Scan()
        self.namespace = ""
        self.scopes: list[dict] = []  # of the open braces
        self.waiting: dict | None = None  # the scope of the next brace
        self.head = 0  # first token of the statement that is being read
        self.nested = 0  # open parentheses and square brackets

    # Small looks at the tokens.

    def at(self, k: int) -> str:
        return self.code[k][3] if 0 <= k < len(self.code) else ""

    def kind(self, k: int) -> str:
        return self.code[k][0] if 0 <= k < len(self.code) else ""

    def name_at(self, k: int) -> str:
        return self.at(k) if self.kind(k) == "name" else ""

    def end_of(self, k: int) -> int:
        return self.code[min(k, len(self.code) - 1)][2] if self.code else 0

    def owner(self) -> dict | None:
        return next((s for s in reversed(self.scopes) if s["kind"] == "class"), None)

    def in_class_body(self) -> bool:
        return bool(self.scopes) and self.scopes[-1]["kind"] in ("class", "nameless")

    def literal(self, k: int) -> str | None:
        """What a string token without interpolation holds."""
        t = self.at(k)
        if self.kind(k) != "string" or len(t) < 2 or (t[0] == '"' and re.search(r"(?<!\\)[$]\w|\{\$", t)):
            return None
        return t[1:-1]

    # The pass.

    def read(self) -> Scan:
        for k, (kind, start, end, t) in enumerate(self.code):
            if kind == "op":
                if t in _MARKS:
                    self.op(k, t)
            elif kind == "name":
                self.name(k, t)
            elif kind == "string":
                content = self.literal(k)
                if content:
                    self.place("string", content, start + 1, end - 1)
        for scope in [*self.scopes, *([self.waiting] if self.waiting else [])]:
            self.close(scope, len(self.text))
        for s in self.out.symbols:
            s["source_text"] = self.text[s["start"] : s["end"]]
        return self.out

    def place(self, kind: str, literal: str, start: int, end: int, arguments: int | None = None) -> None:
        self.out.places.append((kind, literal, start, end, arguments))

    def op(self, k: int, t: str) -> None:
        if t in "([":
            self.nested += 1
        elif t == "#[":
            self.nested += 1
            self.attributes(k)
        elif t in ")]":
            self.nested = max(0, self.nested - 1)
        elif t == "{":
            self.scopes.append((self.waiting or {"kind": "block"}) | {"nested": self.nested})
            self.waiting, self.nested, self.head = None, 0, k + 1
        elif t == "}":
            if self.scopes:
                scope = self.scopes.pop()
                self.close(scope, self.code[k][2])
                self.nested = scope["nested"]
            self.head = k + 1
        elif t == ";" and not self.nested:
            if self.waiting:
                self.close(self.waiting, self.code[k][2])
                self.waiting = None
            self.head = k + 1

    def close(self, scope: dict, end: int) -> None:
        for symbol in scope.get("symbols", ()):
            symbol["end"] = end

    def name(self, k: int, t: str) -> None:
        code = self.code
        _, start, end, _ = code[k]
        before, after, low = code[k - 1][3] if k else "", code[k + 1][3] if k + 1 < len(code) else "", t.lower()
        if low in _DECLARING and self.declaring(k, low, before, after):
            return
        if before == "->" or before == "?->":
            called = after == "("
            if before == "->":
                self.place("method_call" if called else "property", t, start, end, self.pairs[k + 1][1] if called else None)
            else:
                self.place("name", t, start, end)
        elif before == "::":
            if after == "(":
                self.place("static_call", t, start, end, self.pairs[k + 1][1])
            elif low != "class":
                self.place("name", t, start, end)
        elif "\\" in t:
            if self.class_position(k):
                self.place("class", t.lstrip("\\"), start, end)
        elif after == "(" and low not in _NO_CALL and before not in ("new", "function", "#["):
            close, n = self.pairs[k + 1]
            self.place("call", t, start, end, n)
            self.place("arguments", t, code[k + 1][1], self.end_of(close), n)
            self.deprecated_by_call(k, t)
        elif low not in _NO_NAME:
            self.place("name", t, start, end)

    def declaring(self, k: int, low: str, before: str, after: str) -> bool:
        """Whether a word that can declare something does so here; if it does, that is read."""
        if low == "namespace" and before not in ("->", "::") and (self.kind(k + 1) == "name" or after == "{"):
            self.namespace = self.name_at(k + 1)
        elif low in ("class", "interface", "trait", "enum") and before not in ("::", "->", "?->") and (self.name_at(k + 1) or before == "new"):
            self.class_like(k, low)
        elif low == "function" and before not in ("::", "->", "?->"):
            self.function(k)
        elif low == "const" and before not in ("::", "->") and not self.nested:
            self.constants(k)
        elif low == "global" and self.kind(k + 1) == "var":
            j = k + 1
            while self.kind(j) == "var" or self.at(j) == ",":
                if self.kind(j) == "var":
                    self.place("global", self.at(j).lstrip("$"), self.code[j][1], self.code[j][2])
                j += 1
        else:
            return False
        return True

    def class_position(self, k: int) -> bool:
        """Whether a qualified name stands where classes are imported, created, extended or asked for members."""
        if self.at(k + 1) == "::" or self.at(k - 1).lower() in ("new", "extends"):
            return True
        first = self.head
        return self.at(first).lower() == "use" and not self.in_class_body() and self.at(first + 1).lower() not in ("function", "const") and "{" not in self.at(k + 1)

    # Declarations.

    def declared(self, kind: str, fqn: str, name: str, first: int, **more) -> dict:
        doc = self.docs.get(first)
        symbol = {"symbol_type": kind, "fqn": fqn, "name": name, "namespace": self.namespace or None, "docblock": doc, "start": self.code[first][1], "end": self.code[first][2]} | more
        if doc and "@deprecated" in doc:
            symbol |= {"is_deprecated": 1, "deprecation_version": _one(rf"@deprecated (?:in|since) {self.package}[: ](\d+\.\d+(?:\.\d+)?)", doc), "removal_version": _one(rf"removed from {self.package}:(\d+\.\d+\.\d+)", doc), "deprecation_message": _one(r"Use (.+?) instead", doc)}
        self.out.symbols.append(symbol)
        return symbol

    def first_of(self, k: int) -> int:
        """The first attribute or modifier of a declaration whose keyword is at ``k``."""
        while self.at(k - 1).lower() in _MODIFIERS and k - 1 >= self.head:
            k -= 1
        return self.head if self.at(self.head) == "#[" and self.head < k else k

    def full(self, name: str) -> str:
        return f"{self.namespace}\\{name}" if self.namespace else name

    def class_like(self, k: int, kind: str) -> None:
        name = self.name_at(k + 1)
        named = name and name.lower() not in ("extends", "implements") and self.at(k - 1).lower() != "new"
        j, parts, what = k + 1, {"extends": [], "implements": []}, None
        if not named and self.at(j) == "(":
            j = self.pairs[j][0] + 1
        while j < len(self.code) and self.at(j) not in ("{", ";"):
            if self.at(j).lower() in parts:
                what = self.at(j).lower()
            elif what and self.kind(j) == "name":
                parts[what].append(j)
            j += 1
        if not named:
            self.waiting = {"kind": "nameless"}
            return
        first, fqn = self.first_of(k), self.full(name)
        bases = [self.at(b) for b in parts["extends"]]
        self.waiting = {"kind": "class", "fqn": fqn, "base": bases[0] if bases else None, "head": (self.code[k][1], self.code[parts["extends"][0]][2]) if bases else None, "symbols": []}
        if kind == "enum":
            return
        interfaces = [self.at(b) for b in parts["implements"]]
        shape = json.dumps({"parent": ", ".join(bases) or None, "interfaces": interfaces}) if kind == "class" else None
        symbol = self.declared(kind, fqn, name, first, parent_symbol=bases[0] if bases and kind == "class" else None, signature_json=shape)
        mine = self.waiting["symbols"]
        mine.append(symbol)
        if kind != "class":
            return
        told = annotated_id(symbol["docblock"] or "")
        if told:
            mine.append(self.again(symbol, "plugin_definition", told[1], told[0], {"plugin_type": told[0], "plugin_id": told[1]}))
        if any(i.rsplit("\\", 1)[-1] == "EventSubscriberInterface" for i in interfaces):
            mine.append(self.again(symbol, "event_subscriber", fqn, name, {"events": self.subscribed(j)}))
        for plugin in self.waiting_attributes(first, k):
            self.out.symbols.append(plugin)

    def again(self, symbol: dict, kind: str, fqn: str, name: str, metadata: dict) -> dict:
        other = symbol | {"symbol_type": kind, "fqn": fqn, "name": name, "metadata_json": json.dumps(metadata)}
        self.out.symbols.append(other)
        return other

    def subscribed(self, opening: int) -> list[str]:
        """Strings and class constants of a class body's getSubscribedEvents."""
        last, j = self.pairs.get(opening, (len(self.code), 0))[0], opening + 1
        while j < last and not (self.at(j) == "getSubscribedEvents" and self.at(j - 1).lower() == "function"):
            j += 1
        while j < last and self.at(j) not in ("{", ";"):
            j += 1
        end, events = self.pairs.get(j, (j, 0))[0], []
        for i in range(j + 1, min(end, last)):
            if self.kind(i) == "string":
                events.append(self.at(i).strip("\"'"))
            elif self.at(i) == "::" and self.kind(i - 1) == "name" and self.kind(i + 1) == "name" and self.at(i + 2) != "(":
                events.append(f"{self.at(i - 1)}::{self.at(i + 1)}")
        return list(dict.fromkeys(e for e in events if e))

    def function(self, k: int) -> None:
        j = k + 1 + (self.at(k + 1) == "&")
        name = self.name_at(j)
        if not name or self.at(j + 1) != "(":
            self.waiting = self.waiting or {"kind": "closure"}
            return
        close = self.pairs[j + 1][0]
        params, returns = self.parameters(j + 1, close), self.returns(close)
        first = self.first_of(k)
        shape = json.dumps({"params": params, "return_type": returns})
        if self.in_class_body():
            owner = self.owner() if self.scopes[-1]["kind"] == "class" else None
            words = [self.at(i).lower() for i in range(first, k)]
            seen = next((w for w in words if w in ("public", "protected", "private")), "public")
            symbol = self.declared("method", f"{owner['fqn']}::{name}" if owner else name, name, first, parent_symbol=owner and owner["fqn"], signature_json=shape, visibility=seen, is_static=int("static" in words))
            if owner and owner["base"] and "\\" not in owner["base"]:
                self.place("override", f"{owner['base']}::{name}", *owner["head"])
        else:
            symbol = self.declared("function", self.full(name), name, first, signature_json=shape)
            at = self.code[j]
            for m in re.finditer("_(?=.)", name):
                self.place("hook", name[m.end() :], at[1], at[2])
        self.waiting = {"kind": "function", "symbols": [symbol]}
        base = self.path.rsplit("/", 1)[-1].split(".")[0]
        if symbol["symbol_type"] == "function" and name.startswith(base + "_") and not re.match(r"(?:pre)?process(?:_|$)", name[len(base) + 1 :]):
            hook = symbol | {"symbol_type": "hook", "fqn": name[len(base) + 1 :], "name": name[len(base) + 1 :], "parent_symbol": symbol["fqn"], "signature_json": None}
            self.out.symbols.append(hook)
            self.waiting["symbols"].append(hook)

    def parameters(self, opening: int, close: int) -> list[dict]:
        found, first, j = [], opening + 1, opening + 1
        while j <= close and j <= len(self.code):
            inner = self.pairs.get(j)
            if j == close or self.at(j) == ",":
                variable = next((i for i in range(first, j) if self.kind(i) == "var"), None)
                if variable is not None:
                    start = first
                    while self.at(start) == "#[":
                        start = self.pairs[start][0] + 1
                    while self.at(start).lower() in ("public", "protected", "private", "readonly"):
                        start += 1
                    stop = variable - (self.at(variable - 1) == "...")
                    stop -= self.at(stop - 1) == "&"
                    kind = self.text[self.code[start][1] : self.code[stop - 1][2]] if stop > start else None
                    given = self.text[self.code[variable + 2][1] : self.code[j - 1][2]] if self.at(variable + 1) == "=" and j - 1 >= variable + 2 else None
                    found.append({"name": self.at(variable), "type": kind, "default": given})
                first = j + 1
            j = inner[0] + 1 if inner and j != close else j + 1
        return found

    def returns(self, close: int) -> str | None:
        if self.at(close + 1) != ":":
            return None
        j = close + 2
        while j < len(self.code) and self.at(j) not in ("{", ";"):
            j += 1
        return self.text[self.code[close + 2][1] : self.code[j - 1][2]] if j > close + 2 else None

    def constants(self, k: int) -> None:
        owner = self.owner() if self.in_class_body() and self.scopes[-1]["kind"] == "class" else None
        event = owner and "Event" in owner["fqn"]
        first, j = self.first_of(k), k + 1
        if self.kind(j) == "name" and self.kind(j + 1) == "name":
            j += 1  # a typed constant
        while self.kind(j) == "name" and self.at(j + 1) == "=":
            name = self.at(j)
            symbol = self.declared("event" if event else "constant", f"{owner['fqn']}::{name}" if owner else self.full(name), name, first, parent_symbol=owner and owner["fqn"])
            j += 2
            while j < len(self.code) and self.at(j) not in (",", ";"):
                j = self.pairs[j][0] + 1 if j in self.pairs else j + 1
            symbol["end"] = self.end_of(j)
            j += 1

    # Attributes and deprecations.

    def listed_attributes(self, k: int) -> list[tuple]:
        """(name, index of its parenthesis or None, first and last token) of the attributes of one bracket."""
        close, found, j = self.pairs[k][0], [], k + 1
        while j < close:
            if self.kind(j) == "name":
                opening = j + 1 if self.at(j + 1) == "(" else None
                last = self.pairs[opening][0] if opening else j
                found.append((self.at(j), opening, j, last))
                j = last
            j += 1
        return found

    def attributes(self, k: int) -> None:
        for name, opening, first, last in self.listed_attributes(k):
            if opening and name.rsplit("\\", 1)[-1] == "Hook":
                hook = next((self.at(i).strip("\"'") for i in range(opening, min(last, len(self.code))) if self.kind(i) == "string"), "")
                if hook:
                    owner = self.owner()
                    self.out.symbols.append({"symbol_type": "hook", "fqn": hook, "name": hook, "namespace": self.namespace or None, "parent_symbol": owner and owner["fqn"], "start": self.code[first][1], "end": self.end_of(last)})

    def waiting_attributes(self, first: int, k: int) -> list[dict]:
        """Plugin definitions by the attributes before a class: the argument named id, else the first string without a name."""
        found, j = [], first
        while j < k:
            if self.at(j) == "#[":
                for name, opening, begin, last in self.listed_attributes(j):
                    plugin = self.plugin_id(opening, last) if opening and name.rsplit("\\", 1)[-1] != "Hook" else None
                    if plugin:
                        found.append({"symbol_type": "plugin_definition", "fqn": plugin, "name": name, "namespace": self.namespace or None, "metadata_json": json.dumps({"plugin_type": name, "plugin_id": plugin}), "start": self.code[begin][1], "end": self.end_of(last)})
                j = self.pairs[j][0]
            j += 1
        return found

    def plugin_id(self, opening: int, close: int) -> str | None:
        first, j = None, opening + 1
        while j < close:
            named = self.kind(j) == "name" and self.at(j + 1) == ":"
            value = j + 2 if named else j
            if self.kind(value) == "string" and self.at(value + 1) in (",", ")"):
                if named and self.at(j) == "id":
                    return self.at(value).strip("\"'")
                if not named and first is None:
                    first = self.at(value).strip("\"'")
            elif named and self.at(j) == "id":
                return first
            while j < close and self.at(j) != ",":
                j = self.pairs[j][0] + 1 if j in self.pairs else j + 1
            j += 1
        return first

    def plain_arguments(self, opening: int) -> list[str | None]:
        """The arguments between two parentheses that are a single string, as what that holds; None for others."""
        close, found, first, j = self.pairs[opening][0], [], opening + 1, opening + 1
        while j <= close:
            if j == close or self.at(j) == ",":
                found.append(self.literal(first) if j == first + 1 else None)
                first = j + 1
            j = self.pairs[j][0] + 1 if j in self.pairs and j != close else j + 1
        return found

    def deprecated_by_call(self, k: int, name: str) -> None:
        """A call that triggers a deprecation tells about the declaration that was read last."""
        if name not in ("trigger_error", "trigger_deprecation") or not self.out.symbols:
            return
        told = self.text[self.code[k + 1][1] : self.end_of(self.pairs[k + 1][0])]
        if name == "trigger_deprecation":  # (package, version, message, ...)
            versions = (next(iter([v for v in self.plain_arguments(k + 1)[1:2] if v]), None), None)
        else:
            versions = (_one(rf"is deprecated in {self.package}:(\d+\.\d+\.\d+)", told), _one(rf"is removed from {self.package}:(\d+\.\d+\.\d+)", told))
        last, hint = self.out.symbols[-1], _one(r"Use (.+?) instead", told)
        last |= {"is_deprecated": 1, "deprecation_message": told, "deprecation_version": versions[0], "removal_version": versions[1]}
        if hint:
            last["metadata_json"] = json.dumps({"replacement_hint": hint})


_ANNOTATION = re.compile(r"@(?P<name>\w+)\s*\(|(?P<text>\"[^\"]*\"|'[^']*')|(?P<word>\w+)|(?P<mark>\S)")


def annotated_id(doc: str) -> tuple[str, str] | None:
    """Name and id of the first annotation of a docblock whose own arguments name an id.

    Words are read one by one with the open annotations; ``id`` counts where an equals sign or a
    colon and a text follow it, and belongs to the outermost annotation that is open.
    """
    names: list[str] = []
    depth, last = 0, []
    for m in _ANNOTATION.finditer(doc):
        if m["name"]:
            names.append(m["name"])
            depth += 1
        elif m["mark"] in ("(", ")"):
            depth += 1 if m["mark"] == "(" else -1
            names = names if depth > 0 else []
            depth = max(depth, 0)
        elif names and m["text"] and last[-2:] in (["id", "="], ["id", ":"]) and len(m["text"]) > 2:
            return names[0], m["text"][1:-1]
        last = [*last[-1:], m.group()]
    return None


def _one(pattern: str, text: str) -> str | None:
    found = re.search(pattern, text, re.S)
    return found[1].strip() if found else None


class Offsets:
    """Byte offsets and lines of character positions of one text, in one pass over it."""

    def __init__(self, text: str, positions):
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.bytes: dict[int, int] | None = None
        if not text.isascii():
            self.bytes, last, total = {}, 0, 0
            for p in sorted(set(positions)):
                total += len(text[last:p].encode())
                self.bytes[p], last = total, p

    def byte(self, position: int) -> int:
        return position if self.bytes is None else self.bytes[position]

    def line(self, position: int) -> int:
        return bisect.bisect_left(self.lines, position) + 1
