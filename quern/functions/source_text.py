"""Source routines and their statements in a form that can be compared, without Spark."""

from __future__ import annotations

import re

# Other names of types, and types that open a declaration (longer names before their
# beginnings).
ALIASES = {"int": "integer", "bool": "boolean", "unsignedinteger": "uint", "unsignedlong": "ulong", "character": "char"}
DECLARED = ("datetime", "decimal", "boolean", "integer", "string", "double", "ulong", "uint", "long", "real", "blob", "byte", "char", "date", "time", "any")

#: A string literal in either quote, with ~ escapes; an open one runs to the end.
_LITERAL = r"""'(?:~.|[^'~])*+(?:'|~?\Z)|"(?:~.|[^"~])*+(?:"|~?\Z)"""
_literal = re.compile(_LITERAL, re.S)
_comment = re.compile(rf"({_LITERAL})|//[^\n]*|/\*.*?(?:\*/|\Z)", re.S)
_continued = re.compile(rf"({_LITERAL})|&\s*", re.S)
_pieces = re.compile(rf"({_LITERAL})|([\n\r;])", re.S)
_tokens = re.compile(rf"({_LITERAL})|([\w\x01]+)|(\s+)|(.)", re.S)


def type_alias(name: str) -> str:
    name = name.strip().lower()
    return ALIASES.get(name, name)


def strip_comments(text: str) -> str:
    """Without comments outside strings; their line breaks stay."""
    return _comment.sub(lambda m: m[1] if m[1] else "\n" * m[0].count("\n"), text)


def join_continuations(text: str) -> str:
    """Without `&` outside strings and the white space after it."""
    return _continued.sub(lambda m: m[1] or "", text)


def split_statements(text: str) -> list[str]:
    """At line breaks and semicolons outside strings; blank parts are left out."""
    out, start = [], 0
    for m in _pieces.finditer(text):
        if m[2]:
            out.append(text[start : m.start()])
            start = m.end()
    return [s for s in [*out, text[start:]] if s.strip()]


def _lower_literal(text: str) -> str:
    return re.sub(r"~.|[^~]+|~", lambda m: m[0] if m[0][0] == "~" else m[0].lower(), text, flags=re.S)


def normalise_statement(statement: str) -> str:
    """Lower case (escaped characters stay), no white space outside strings, one name per type, and no
    `this.` anywhere."""
    out = []
    for literal, word, blank, other in _tokens.findall(statement):
        if literal:
            out.append(_lower_literal(literal))
        elif word:
            out.append(ALIASES.get(word.lower(), word.lower()))
        elif not blank:
            out.append(other)
    return "".join(out).replace("this.", "")


def normalise_body(text: str) -> list[str]:
    """Statements of a body; final returns without a value are left out."""
    out = [n for s in split_statements(join_continuations(strip_comments(text))) if (n := normalise_statement(s))]
    while out and out[-1] == "return":
        out.pop()
    return out


def preview_body(statements: list[str]) -> list[str]:
    return normalise_body("\n".join(statements))


def _masked(text: str) -> str:
    """Strings as NULs, so that places stay and nothing in them is found."""
    return _literal.sub(lambda m: "\0" * len(m[0]), text)


def _compared(masked: str) -> bool:
    """A comparison outside parentheses."""
    depth = 0
    for c in masked:
        depth = depth + 1 if c == "(" else max(0, depth - 1) if c == ")" else depth
        if not depth and c in "=<>":
            return True
    return False


def _root(masked: str) -> str | None:
    """`or`, else `and`, that stands between two comparisons."""
    for op in ("or", "and"):
        if any(_compared(masked[: m.start()]) and _compared(masked[m.end() :]) for m in re.finditer(op, masked)):
            return op
    return None


def _redundant(inside: str, left: str, right: str) -> bool:
    before = next((op for op in ("and", "or") if left.endswith(op)), None)
    after = next((op for op in ("and", "or") if right.startswith(op)), None)
    if (left and not before) or (right and not after):
        return False
    root = _root(inside)
    if root is None:
        return _compared(inside)
    return before in (None, root) and after in (None, root)


def strip_groups(condition: str) -> str:
    """Without the parentheses around comparisons and around equal logical operators."""
    while True:
        masked, open_ = _masked(condition), []
        for i, c in enumerate(masked):
            if c == "(":
                open_.append(i)
            elif c == ")" and open_:
                a = open_.pop()
                left = masked[:a]
                if left and re.match(r"\w", left[-1]) and not left.endswith(("and", "or")):
                    continue
                if _redundant(masked[a + 1 : i], left, masked[i + 1 :]):
                    condition = condition[:a] + condition[a + 1 : i] + condition[i + 1 :]
                    break
        else:
            return condition


def _unwrapped(statement: str, keyword: str) -> str | None:
    """The inside of `keyword(...)` where the parentheses hold all of it."""
    if not statement.startswith(keyword + "("):
        return None
    depth = 0
    masked = _masked(statement)
    for i in range(len(keyword), len(masked)):
        depth += (masked[i] == "(") - (masked[i] == ")")
        if not depth:
            return statement[len(keyword) + 1 : -1] if i == len(masked) - 1 else None
    return None


def canonical_statement(statement: str) -> str:
    """return(x) and destroy(x) without their parentheses, conditions without needless ones, strings in
    double quotes."""
    for keyword in ("return", "destroy"):
        inside = _unwrapped(statement, keyword)
        if inside is not None:
            statement = keyword + inside
            break
    else:
        if statement.startswith("if") and statement.endswith("then"):
            statement = f"if{strip_groups(statement[2:-4])}then"
    return _literal.sub(lambda m: '"' + m[0][1:-1] + '"' if len(m[0]) > 1 and m[0][-1] == m[0][0] else '"' + m[0][1:], statement)


def canonical_body(statements: list[str]) -> list[str]:
    """Inline ifs as blocks, grouped declarations one by one, the rest as canonical_statement."""
    out: list[str] = []
    for s in statements:
        thens = [m.end() for m in re.finditer("then", _masked(s)) if m.start() >= 2] if s.startswith("if") else []
        kind = next((t for t in DECLARED if s.startswith(t)), None)
        names = s[len(kind) :].split(",") if kind else []
        if len(thens) == 1 and thens[0] < len(s):
            out += [canonical_statement(s[: thens[0]]), canonical_statement(s[thens[0] :]), "endif"]
        elif len(names) > 1 and all(re.fullmatch(r"[A-Za-z0-9_]+", n) for n in names):
            out += [kind + n for n in names]
        else:
            out.append(canonical_statement(s))
    return out


def symbol_body(statements: list[str], values: dict[str, str], shadowed: set[str], owners: dict[str, str], context: str = "") -> tuple[list[str], int]:
    """Statements with names of constants replaced by their literals, and how many were. values: literals
    by `owner.name`; owners: the type of a qualifier; a bare name is the context's, else global; shadowed
    names and calls stay."""
    count = 0

    def literal(m: re.Match) -> str:
        nonlocal count
        token, called = m[2], m[3]
        if m[1] or called:
            return m[0]
        owner, _, name = token.rpartition(".")
        if not owner:
            found = None if name in shadowed else values.get(f"{context}.{name}") or values.get(f".{name}")
        else:
            found = values.get(f"{owners.get(owner, owner)}.{name}")
        if found is None:
            return m[0]
        count += 1
        return found

    pattern = re.compile(rf"({_LITERAL})|([^\W\d]\w*(?:\.[^\W\d]\w*)*)(?=(\()?)", re.S)
    return [pattern.sub(literal, s) for s in statements], count


def constant_literal(value: dict) -> str | None:
    """A typed value as it stands in source; None for characters, unresolved values and odd strings."""
    kind = value["kind"]
    if kind in ("signed", "unsigned"):
        return str(value["i"])
    if kind == "boolean":
        return "true" if value["i"] else "false"
    if kind == "string" and not re.search(r"[\x00-\x1f\x7f~'\"]", value["s"]):
        return f'"{value["s"].lower()}"'
    return None


def parameter_types(header: str) -> list[str] | None:
    a, z = header.find("("), header.rfind(")")
    if a < 0 or z < a:
        return None
    if not header[a + 1 : z].strip():
        return []
    kinds = [[w for w in p.split() if w not in ("ref", "readonly")][:1] for p in header[a + 1 : z].split(",")]
    return [type_alias(k[0]) for k in kinds] if all(kinds) else None


def routine_identity(header: str) -> tuple[str, list[str]] | None:
    """(name, parameter types) of an event's, function's or subroutine's head."""
    low = header.strip().lower()
    if low.startswith("event "):
        words = re.split(r"[(;]", low[6:])[0].split()
        return (words[-1].rpartition("::")[2], parameter_types(low) or []) if words else None
    m = re.search(r"\b(?:function|subroutine)\b(.*)", low, re.S)
    if not m or "(" not in m[1]:
        return None
    words, kinds = m[1].partition("(")[0].split(), parameter_types(m[1])
    return (words[-1], kinds) if words and kinds is not None else None


def _head(line: str) -> tuple[tuple[str, list[str]], str, str] | None:
    """((name, parameter types), terminator, what stands on the line after the head)."""
    line = line.lstrip()
    low = line.lower()
    if low.startswith("on "):
        return (low[3:].strip().rpartition(".")[2].strip(), []), "end on", ""
    end = _masked(line).find(";")
    if end < 0:
        return None
    head = low[:end]
    kind = "event" if head.startswith("event ") else "function" if re.search(r"\bfunction\b", head) else "subroutine" if re.search(r"\bsubroutine\b", head) else None
    identity = routine_identity(head) if kind else None
    return (identity, f"end {kind}", line[end + 1 :]) if identity else None


def source_routines(text: str, place: str = "") -> list[dict]:
    """name, parameter_types, source_reference (place:line), body of each routine. Prototype sections and
    routines without an end are left out."""
    lines, out, i, prototypes = text.splitlines(), [], 0, False
    while i < len(lines):
        line = lines[i].strip().lower()
        prototypes = line in ("type prototypes", "forward prototypes") or (prototypes and line != "end prototypes")
        found = None if prototypes else _head(lines[i])
        i += 1
        if found:
            (name, kinds), end, inline = found
            start = i
            while i < len(lines) and lines[i].strip().lower() != end:
                i += 1
            if i < len(lines):
                out.append({"name": name, "parameter_types": kinds, "source_reference": f"{place}:{start}", "body": normalise_body("\n".join([inline, *lines[start:i]]))})
                i += 1
    return out


def _lcs_row(row: int, places: int, full: int) -> int:
    """The next row of a longest-common-subsequence table, a bit a column: a zero where the length grows."""
    shared = row & places
    return ((row + shared) | (row - shared)) & full


def alignment(a: list[str], b: list[str]) -> tuple[list[str], list[str], int]:
    """(only in a, only in b, matched) of a longest common subsequence; where both ways are as long, a is
    passed over first.

    Rows of the table are numbers with a bit for each element of b, from the end of both lists. Every
    `step`-th row is kept and the ones between are made again when the way comes to them: about the root
    of a's length in rows of len(b) bits, and a 64th of a table's work.
    """
    n, m = len(a), len(b)
    full = (1 << m) - 1
    places: dict[str, int] = {}
    for j, x in enumerate(reversed(b)):
        places[x] = places.get(x, 0) | 1 << j
    step = max(1, int(n**0.5))
    kept, row = [full], full
    for k in range(1, n + 1):
        row = _lcs_row(row, places.get(a[n - k], 0), full)
        if not k % step:
            kept.append(row)
    # rows[k - low]: for the last k elements of a. A way from i uses those of n - i and n - i - 1.
    low, rows = -1, []
    i = j = matched = 0
    left, right = [], []
    while i < n and j < m:
        if a[i] == b[j]:
            i, j, matched = i + 1, j + 1, matched + 1
            continue
        k = n - i
        if low < 0 or k - 1 < low:
            low = (k - 1) // step * step
            rows = [kept[low // step]]
            for q in range(low + 1, min(low + step, n) + 1):
                rows.append(_lcs_row(rows[-1], places.get(a[n - q], 0), full))
        mask = (1 << (m - j)) - 1
        if (rows[k - low] & mask).bit_count() == (rows[k - 1 - low] & mask).bit_count():
            left.append(a[i])
            i += 1
        else:
            right.append(b[j])
            j += 1
    return left + a[i:], right + b[j:], matched
