"""Statements of a function from its instructions: a fold over an expression stack.

The opcode table's `rule` column says what an instruction does (see RULES); an opcode without a rule is
an open gap. A gap clears the stack, so that what depends on it is open as well, and is kept with its
offset and reason. A region is folded by one task; catalogues go along with it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.bytesio import FormatError, decimal_at, double_at, escaped, identifier_at, type_name, u16_at, u32_at, utf16_at
from quern.operators.flow import control_flow, scaffolding

# Names that binaries leave out. Functions and enumerated values by (type, index); members
# by (type, index) with their types.
SYSTEM_FUNCTIONS = {
    (0x40D5, 20): "classname", (0x40D5, 25): "closewithreturn", (0x40D5, 57): "fileexists", (0x40D5, 65): "fileopen", (0x40D5, 106): "getfilesavename",
    (0x40D5, 176): "messagebox", (0x40D5, 177): "messagebox", (0x40D5, 187): "open", (0x40D5, 271): "openwithparm", (0x40D5, 279): "pos",
    (0x40D5, 319): "profilestring", (0x40D5, 323): "registryget", (0x40D5, 332): "registryset", (0x40D5, 342): "rgb", (0x40D5, 357): "setpointer",
    (0x40D5, 359): "setprofilestring", (0x40D5, 371): "showhelp", (0x40D5, 372): "showhelp", (0x40D5, 373): "showhelp", (0x40D5, 387): "string",
    (0x40D5, 388): "string", (0x40D5, 399): "today", (0x40D5, 409): "trim", (0x40D5, 416): "year",
}
SYSTEM_ENUMS = {
    (0x4007, 0): "ok", (0x4017, 1): "write", (0x4018, 2): "lockwrite", (0x4019, 0): "linemode", (0x402D, 0): "index", (0x402D, 1): "topic", (0x402D, 2): "keyword",
    (0x402F, 1): "stopsign", (0x402F, 2): "exclamation", (0x403F, 0): "listviewlargeicon", (0x403F, 1): "listviewsmallicon", (0x403F, 2): "listviewlist",
    (0x403F, 3): "listviewreport", (0x4055, 8): "hourglass", (0x4067, 9): "currenttreeitem", (0x4070, 1): "replace",
}
EXTERNAL_MEMBERS = {
    ("n_exampleappmanager", 2): ("iapp_object", "application"), ("n_exampleappmanager", 3): ("ienv_object", "environment"), ("application", 6): ("toolbarusercontrol", "boolean"),
    ("application", 10): ("displayname", "string"), ("environment", 5): ("ostype", "ostypes"), ("environment", 10): ("win16", "boolean"), ("menu", 3): ("text", "string"),
    ("listview", 51): ("view", "listviewview"), ("listviewitem", 4): ("label", "string"), ("listviewitem", 5): ("pictureindex", "integer"), ("listviewitem", 8): ("itemx", "integer"),
    ("listviewitem", 9): ("itemy", "integer"), ("treeviewitem", 5): ("expanded", "boolean"), ("treeviewitem", 9): ("level", "integer"), ("treeviewitem", 10): ("label", "string"),
}
#: How tightly operators bind, as the statements that are compared have it: an operand is put in
#: parentheses if its own number is smaller. `corrected` ones give sums inside products theirs.
BINDING = {"+": 5, "-": 5, "*": 4, "/": 4, "^": 3, "and": 2, "or": 2, "=": 1, "<>": 1, ">": 1, "<": 1, ">=": 1, "<=": 1}
CORRECTED = {"^": 7, "*": 6, "/": 6, "+": 5, "-": 5, "=": 4, "<>": 4, ">": 4, "<": 4, ">=": 4, "<=": 4, "and": 2, "or": 1}


@dataclass
class Catalogue:
    """Names from other entries: members and parents by type (lower case), system functions and values."""

    members: dict[str, dict[int, tuple[str, str]]] = field(default_factory=dict)
    parents: dict[str, str] = field(default_factory=dict)
    functions: dict[tuple[int, int], str] = field(default_factory=dict)
    enums: dict[tuple[int, int], str] = field(default_factory=dict)

    def ancestors(self, name: str) -> Iterator[str]:
        """The type and what it inherits from, nearest first; a cycle ends where it closes."""
        seen: set[str] = set()
        while name and name.lower() not in seen:
            seen.add(name.lower())
            yield name.lower()
            name = self.parents.get(name.lower(), "")

    def member(self, owner: str, index: int) -> tuple[str, str] | None:
        found = next((self.members[t][index] for t in self.ancestors(owner) if index in self.members.get(t, {})), None)
        return found or EXTERNAL_MEMBERS.get((owner.lower(), index))

    def member_named(self, owner: str, name: str) -> tuple[str, str] | None:
        return next((m for t in self.ancestors(owner) for m in self.members.get(t, {}).values() if m[0].lower() == name.lower()), None)

    def parent(self, name: str, levels: int) -> str | None:
        for _ in range(levels):
            name = self.parents.get(name.lower(), "")
        return name or None

    def function(self, owner: int, index: int) -> str | None:
        return self.functions.get((owner, index)) or SYSTEM_FUNCTIONS.get((owner, index))

    def enum(self, kind: int, index: int) -> str | None:
        return self.enums.get((kind, index)) or SYSTEM_ENUMS.get((kind, index))


def catalogue_of(objects: list[dict]) -> Catalogue:
    """Catalogue of parsed objects (rows of quern.sources.objects). A member's index counts what its type
    inherits first. The first entry of a key holds."""
    out = Catalogue()
    for o in objects:
        for d in o["objects"]:
            own = [v for v in d["properties"] if v["is_instance"]]
            base = d["all_variable_count"] - len(own)
            if base < 0:
                raise FormatError(f"{d['type_name']}: more members than variables")
            members = out.members.setdefault(d["type_name"].lower(), {})
            for k, v in enumerate(own):
                members.setdefault(base + k, (v["name"], v["type_name"]))
            out.parents.setdefault(d["type_name"].lower(), d["inherit_type_name"])
            if d["type_ref"] & 0xF000 == 0x4000:
                for f in d["functions"]:
                    out.functions.setdefault((d["type_ref"], f["index"]), f["name"])
        for e in o["enum_values"]:
            if e["enum_type_ref"] & 0xF000 == 0x4000:
                out.enums.setdefault((e["enum_type_ref"], e["item_index"]), e["name"])
    return out


class Gap(Exception):
    """An instruction that cannot be told; the text is the reason."""


@dataclass(slots=True)
class Value:
    text: str
    operator: str = ""
    kind: str | None = None


@dataclass
class Context:
    """What a function's instructions refer to."""

    variables: list[dict]
    globals_: list[dict] = field(default_factory=list)
    types: dict[int, str] = field(default_factory=dict)
    enums: dict[tuple[int, int], str] = field(default_factory=dict)
    catalogue: Catalogue = field(default_factory=Catalogue)
    owner: str | None = None
    parent: str | None = None
    referenced: list[dict] = field(default_factory=list)
    strings: bytes = b""
    corrected: bool = True


class Fold:
    """The stack and the statements so far."""

    def __init__(self, context: Context):
        self.c, self.stack, self.out = context, [], []
        self.binding = CORRECTED if context.corrected else BINDING

    def pop(self, what: str) -> Value:
        if not self.stack:
            raise Gap(f"{what} is missing")
        return self.stack.pop()

    def push(self, text: str, kind: str | None = None, operator: str = "") -> None:
        self.stack.append(Value(text, operator, kind))

    def say(self, row: dict, text: str) -> None:
        self.out.append((row["offset"], text))

    def arguments(self, n: int, what: str, more: int = 0) -> str:
        if len(self.stack) < n + more:
            raise Gap(f"{what} requires {n + more} value(s), the stack has {len(self.stack)}")
        taken = self.stack[len(self.stack) - n :]
        del self.stack[len(self.stack) - n :]
        return ", ".join(v.text for v in taken)

    def returned(self) -> bool:
        return bool(self.out) and self.out[-1][1].startswith("return")


def word(row: dict, k: int = 0) -> int:
    if k >= len(row["operands"]):
        raise Gap(f"operand {k} is missing")
    return row["operands"][k]


def long(row: dict, k: int = 0) -> int:
    return word(row, k) | word(row, k + 1) << 16


def _binary(operator: str) -> Callable[[Fold, dict], None]:
    def rule(f: Fold, row: dict) -> None:
        right, left = f.pop(f"{operator} right operand"), f.pop(f"{operator} left operand")
        own = f.binding[operator]

        def side(v: Value, last: bool) -> str:
            theirs = f.binding.get(v.operator, 99)
            wrap = theirs < own or (f.c.corrected and last and theirs == own and operator in "-/^")
            return f"({v.text})" if wrap else v.text

        f.push(f"{side(left, False)} {operator} {side(right, True)}", operator=operator)

    return rule


def _unary(operator: str) -> Callable[[Fold, dict], None]:
    def rule(f: Fold, row: dict) -> None:
        v = f.pop(f"{operator} operand")
        f.push(f"{operator}({v.text})" if v.operator else f"{operator}{v.text}", operator="")

    return rule


def _call(name: str, kind: str | None) -> Callable[[Fold, dict], None]:
    def rule(f: Fold, row: dict) -> None:
        f.push(f"{name}({f.pop(f'{name} value').text})", kind)

    return rule


def _statement(make: Callable[[Fold, dict], str]) -> Callable[[Fold, dict], None]:
    def rule(f: Fold, row: dict) -> None:
        f.say(row, make(f, row))

    return rule


def _variable(f: Fold, row: dict) -> None:
    k = word(row)
    if k >= len(f.c.variables):
        raise Gap(f"local-variable index {k} is out of bounds")
    f.push(f.c.variables[k]["name"], f.c.variables[k]["type_name"])


def _global(f: Fold, row: dict) -> None:
    k = word(row)
    v = next((v for v in f.c.variables if v["is_referenced_global"] and v["raw"] == k), f.c.globals_[k] if k < len(f.c.globals_) else None)
    if v is None:
        raise Gap(f"shared-variable index {k} is out of bounds")
    f.push(v["name"], v["type_name"])


def _member(f: Fold, row: dict) -> None:
    at = long(row)
    if at + 8 > len(f.c.strings):
        raise Gap(f"member descriptor 0x{at:08X} is out of range")
    offset, index = u32_at(f.c.strings, at), u16_at(f.c.strings, at + 4)
    receiver = f.stack[-1].kind if f.stack else None
    own = identifier_at(f.c.strings, offset, dash=False) if offset & 0xFFFF != 0xFFFF else None
    known = f.c.catalogue.member(receiver, index) if receiver else None
    if own and known and own.lower() != known[0].lower():
        raise Gap(f"member descriptor name {own} does not match catalog name {known[0]}")
    known = known or (f.c.catalogue.member_named(receiver, own) if receiver and own else None)
    if not own and not known:
        raise Gap(f"member name is external for {receiver or 'unknown type'} index {index}")
    f.push(own or known[0], known[1] if known else None)


def _access(f: Fold, row: dict) -> None:
    member, receiver = f.pop("member name"), f.pop("member receiver")
    f.push(f"{receiver.text}.{member.text}", member.kind)


def _index(f: Fold, row: dict) -> None:
    index, array = f.pop("array index"), f.pop("indexed array")
    f.push(f"{array.text}[{index.text}]", array.kind)


def _indexed_member(f: Fold, row: dict) -> None:
    index, member, receiver = f.pop("member index"), f.pop("indexed member"), f.pop("indexed receiver")
    f.push(f"{receiver.text}.{member.text}[{index.text}]", member.kind)


def _bound(name: str) -> Callable[[Fold, dict], None]:
    def rule(f: Fold, row: dict) -> None:
        array, k = f.pop(f"{name} array").text, word(row)
        f.push(f"{name}({array})" if k <= 1 else f"{name}({array}, {k})", "long")

    return rule


def _array(f: Fold, row: dict) -> None:
    f.push("{" + f.arguments(word(row, 2), "array list") + "}")


def call_name(name: str, flags: int) -> str:
    """post, dynamic and event by the flags' lowest bits."""
    return " ".join([w for bit, w in ((1, "post"), (2, "dynamic"), (4, "event")) if flags & bit] + [name])


def _method(f: Fold, row: dict) -> None:
    at = long(row)
    name = identifier_at(f.c.strings, u32_at(f.c.strings, at + 4)) if at + 8 <= len(f.c.strings) else None
    if name is None:
        raise Gap(f"call descriptor 0x{at:08X} is out of range")
    n = word(row, 2)
    arguments = f.arguments(n, "function call", 1) if len(f.stack) > n else f.arguments(n + 1, "function call")
    flags = row["operands"][3] if len(row["operands"]) > 3 else 0
    f.push(f"{f.pop('receiver').text}.{call_name(name, flags)}({arguments})")


def _super(f: Fold, row: dict) -> None:
    name = identifier_at(f.c.strings, long(row, 3))
    if name is None:
        raise Gap("super-call name is out of range")
    arguments = f.arguments(word(row, 1), "super call")
    f.push(f"call super::{name}" + (f"({arguments})" if arguments else ""))


def _function_class(f: Fold, row: dict) -> None:
    k, owner = word(row), word(row, 1)
    if owner & 0x8000:
        name = f.c.referenced[k]["name"] if k < len(f.c.referenced) else None
        reason = f"referenced-function index {k} is out of bounds"
    else:
        name = f.c.catalogue.function(owner, k) if owner & 0x4000 else None
        reason = f"unknown system-function reference 0x{owner:04X}:{k}"
    if name is None:
        raise Gap(reason)
    f.push(name)


def _global_call(f: Fold, row: dict) -> None:
    n, flags = word(row, 1), word(row, 2)
    name = f.pop("global function name").text
    f.push(f"{call_name(name, flags)}({f.arguments(n, 'global function call')})")


def _parent(f: Fold, row: dict) -> None:
    n = word(row)
    kind = f.c.catalogue.parent(f.c.owner, n) if n and f.c.owner else None
    if kind is None:
        raise Gap(f"parent depth {n} is unavailable")
    f.push(".".join(["parent"] * n), kind)


def _create(f: Fold, row: dict) -> None:
    at = long(row)
    name = identifier_at(f.c.strings, u32_at(f.c.strings, at), dash=False) if at + 8 <= len(f.c.strings) else None
    if name is None:
        raise Gap(f"type descriptor 0x{at:08X} is out of range")
    known = type_name(u16_at(f.c.strings, at + 4), f.c.types)
    if not known.startswith(("type_", "system_type_")) and known.lower() != name.lower() and known:
        raise Gap(f"type descriptor name {name} does not match {known}")
    f.push(f"create {name}", name)


def _enum(f: Fold, row: dict) -> None:
    key = word(row, 1), word(row)
    name = f.c.enums.get(key) or f.c.catalogue.enum(*key)
    if name is None:
        raise Gap(f"unknown enum constant 0x{key[0]:04X}:{key[1]}")
    f.push(f"{name}!")


def _string(f: Fold, row: dict) -> None:
    text = utf16_at(f.c.strings, long(row), odd=True)
    if text is None:
        raise Gap(f"invalid string offset 0x{long(row):08X}")
    f.push(f'"{escaped(text)}"')


def _number(read: Callable[[bytes, int], str], kind: str) -> Callable[[Fold, dict], None]:
    def rule(f: Fold, row: dict) -> None:
        try:
            f.push(read(f.c.strings, long(row)), kind)
        except FormatError as e:
            raise Gap(str(e)) from e

    return rule


def _jump_if(f: Fold, row: dict) -> str:
    target, condition = word(row), f.pop("condition").text
    if row["opcode"] == 3:
        condition = f"not ({condition})" if f.c.corrected and " " in condition else f"not {condition}"
    return f"if {condition} then goto L_{target:04X}"


def _return(f: Fold, row: dict) -> None:
    if not f.returned():
        f.say(row, "return")


def _jump(f: Fold, row: dict) -> None:
    target = word(row)
    if not f.returned():
        f.say(row, f"goto L_{target:04X}")


def _return_value(f: Fold, row: dict) -> str:
    return f"return {f.pop('return value').text}" if row["operands"][:1] == [1] else "return"


def _assign(f: Fold, row: dict) -> str:
    value, target = f.pop("assigned value"), f.pop("assignment target")
    return f"{target.text} = {value.text}"


def _halt(f: Fold, row: dict) -> str:
    if word(row) > 1:
        raise Gap(f"unknown halt mode {word(row)}")
    return ("halt close", "halt")[word(row)]


def _needs_value(f: Fold, row: dict) -> None:
    if not f.stack:
        raise Gap("a value is required, the stack is empty")


def signed(value: int, bits: int) -> int:
    return value - (value >> bits - 1 << bits)


RULES: dict[str, Callable[[Fold, dict], None]] = {
    **{f"binary {op}": _binary(op) for op in BINDING if op not in ("and", "or")},
    "and": _binary("and"), "or": _binary("or"), "not": _unary("not "), "unary -": _unary("-"),
    "return": _return, "return-value": _statement(_return_value), "cond-jump": _statement(_jump_if), "jump": _jump,
    "commit": _statement(lambda f, r: f"commit using {f.pop('transaction').text}"), "rollback": _statement(lambda f, r: f"rollback using {f.pop('transaction').text}"),
    "destroy": _statement(lambda f, r: f"destroy({f.pop('destroyed value').text})"), "halt": _statement(_halt),
    "stmt-expr": _statement(lambda f, r: f.pop("statement").text), "assign": _statement(_assign),
    "convert (transparent)": _needs_value, "call-cleanup": _needs_value, "bookkeeping": lambda f, r: None,
    "local-var": _variable, "assign-target": _variable, "shared/global-var": _global,
    "this": lambda f, r: f.push("this", f.c.owner), "parent": lambda f, r: f.push("parent", f.c.parent), "nth-parent": _parent,
    "member-ref": _member, "member-access": _access, "array-index": _index, "indexed-member": _indexed_member, "array-literal": _array,
    "lowerbound()": _bound("lowerbound"), "upperbound()": _bound("upperbound"),
    "method-call": _method, "call-super": _super, "func-class": _function_class, "global-call": _global_call, "create": _create,
    "const-i16": lambda f, r: f.push(str(signed(word(r), 16))), "const-u16": lambda f, r: f.push(str(word(r))),
    "const-i32": lambda f, r: f.push(str(signed(long(r), 32))), "const-u32": lambda f, r: f.push(str(long(r))),
    "const-bool": lambda f, r: f.push("true" if word(r) == 1 else "false"), "const-string": _string, "const-enum": _enum,
    "const-decimal": _number(decimal_at, "decimal"), "const-double": _number(double_at, "double"),
    **{f"{name}()": _call(name, kind) for name, kind in (("isdate", "boolean"), ("isnull", "boolean"), ("isnumber", "boolean"), ("istime", "boolean"), ("isvalid", "boolean"), ("len", "long"), ("lower", "string"))},
}


def signature(d: dict) -> str:
    """A function's head: access by its flags, kind, return type, name, parameters."""
    parameters = ", ".join(f"{'readonly ' if p['is_read_only'] else 'ref ' if p['is_reference'] else ''}{p['type_name']} {p['name']}{p['array']}" for p in d["parameters"])
    if d["flags"] & 0x01:
        return f"event {d['name']}({parameters})"
    access = "private " if d["flags"] & 0x20 else "protected " if d["flags"] & 0x10 else "public "
    return access + (f"function {d['return_type_name']} {d['name']}({parameters})" if d["return_type_name"] else f"subroutine {d['name']}({parameters})")


def single_arm_if(rows: list[dict], flow: dict, out: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The statements with `if ... then` and `end if` where the region's only jump on a condition goes
    forward over one straight run."""
    jumps = [r for r in rows if r["opcode"] in (2, 3)]
    if len(jumps) != 1 or jumps[0]["opcode"] != 3 or flow["exceptions"] or not flow["valid"]:
        return out
    start, target = jumps[0]["offset"], jumps[0]["operands"][0]
    inside = [r for r in rows if r["opcode"] == 4 and not (start < r["offset"] < target and r["operands"][0] >= target)]
    if target <= start or inside:
        return out
    made, done = [], False
    for offset, text in out:
        if offset >= target and not done:
            made.append((target, "end if"))
            done = True
        if offset == start:
            condition = text.removeprefix("if ").partition(" then goto")[0].removeprefix("not ")
            text = f"if {condition.removeprefix('(').removesuffix(')') if condition.startswith('(') else condition} then"
        if start < offset < target and text.startswith("goto "):
            continue
        made.append((offset, text))
    return made if done else [*made, (target, "end if")]


def preview(rows: list[dict], length: int, complete: bool, rules: dict[int, str], context: Context, definition: dict | None = None) -> dict:
    """signature, declarations, statements, gaps (offset, opcode, mnemonic, reason), n_instructions,
    n_supported, coverage (100 if there are no instructions), complete, flow_valid, try_catch (setup, end, catches
    of the structures whose catches' variables are all known; none unless the flow is valid)."""
    f = Fold(context)
    flow = control_flow(rows, length, complete)
    quiet = scaffolding(flow) if flow["valid"] else set()
    marks: dict[int, list[str]] = {}
    known = [x for x in flow["exceptions"] if all(h["variable"] < len(context.variables) for h in x["handlers"])] if flow["valid"] else []
    structures = []
    for x in known:
        catches = [(h["body"], context.variables[h["variable"]]) for h in x["handlers"]]
        structures.append({"setup": x["setup"], "end": x["end"], "catches": [{"exception_type": v["type_name"], "variable_name": v["name"]} for _, v in catches]})
        marks.setdefault(x["setup"], []).append("try")
        for at, v in catches:
            marks.setdefault(at, []).append(f"catch ({v['type_name']} {v['name']})")
        marks.setdefault(x["end"], []).append("end try")
    gaps, supported = [], 0
    for row in rows:
        if marks:
            for text in marks.get(row["offset"], []):
                f.say(row, text)
        if quiet and row["offset"] in quiet:
            supported += 1
            continue
        rule = RULES.get(rules.get(row["opcode"], ""))
        try:
            if rule is None:
                raise Gap("semantic rule not implemented")
            rule(f, row)
            supported += 1
        except Gap as e:
            gaps.append({"offset": row["offset"], "opcode": row["opcode"], "mnemonic": row["mnemonic"], "reason": str(e)})
            f.say(row, f"/* unresolved {row['mnemonic']} {' '.join(f'0x{w:04X}' for w in row['operands'])}".rstrip() + " */")
            f.stack.clear()
    statements = single_arm_if(rows, flow, f.out)
    declared = context.variables[len(definition["parameters"]) if definition else 0 :]
    return {
        "signature": signature(definition) if definition else None, "declarations": [f"{v['type_name']} {v['name']}{v['array']}" for v in declared], "statements": [t for _, t in statements], "gaps": gaps,
        "n_instructions": len(rows), "n_supported": supported, "coverage": 100.0 * supported / len(rows) if rows else 100.0, "complete": complete and flow["valid"] and not gaps and not f.stack, "flow_valid": flow["valid"], "try_catch": structures,
    }


_PREVIEW = "signature string, declarations array<string>, statements array<string>, gaps array<struct<offset: long, opcode: int, mnemonic: string, reason: string>>, n_instructions long, n_supported long, coverage double, complete boolean, flow_valid boolean, try_catch array<struct<setup: long, end: long, catches: array<struct<exception_type: string, variable_name: string>>>>"
#: What the scan of a region's code and lines gives; for `measured`.
_SCAN = "scanned boolean, length long, consumed long, branches long, invalid_branches long, debug_records long, debug_valid boolean"


def preview_regions(regions: DataFrame, keys: list[str], table: dict, major: int, catalogue: Catalogue | None = None, corrected: bool = True, measured: bool = False) -> DataFrame:
    """Keys and a preview of each region: rows of `regions` have region (JSON of a row of a compiled object's
    regions) and context (JSON: globals, types, enums, owner, parent; any may be missing). With `measured`
    also _SCAN, from the same pass."""
    from quern.operators.scan import debug_map, scan

    rules = {k: v[3] for k, v in table.items()}
    known = catalogue or Catalogue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, around in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True):
                r, c = json.loads(text), json.loads(around or "{}")
                code = bytes.fromhex(r["pcode"])
                found = scan(code, major, table)
                context = Context(r.get("variables") or [], c.get("globals") or [], {t["type_ref"]: t["name"] for t in c.get("types") or []}, {(e["enum_type_ref"], e["item_index"]): e["name"] for e in c.get("enums") or []}, known, c.get("owner"), c.get("parent"), r.get("referenced_functions") or [], bytes.fromhex(r.get("stack_buffer") or ""), corrected)
                debug = debug_map(bytes.fromhex(r.get("debug") or ""), found["instructions"])
                counts = {"scanned": found["complete"], "length": len(code), "consumed": found["consumed"], "branches": len(found["branches"]), "invalid_branches": sum(not b["valid"] for b in found["branches"]), "debug_records": debug["records"], "debug_valid": debug["valid"]}
                rows.append(counts | preview(found["instructions"], len(code), found["complete"], rules, context, r.get("definition")))
            kinds = [("signature", pa.string()), ("declarations", pa.list_(pa.string())), ("statements", pa.list_(pa.string())), ("gaps", pa.list_(pa.struct([("offset", pa.int64()), ("opcode", pa.int32()), ("mnemonic", pa.string()), ("reason", pa.string())]))), ("n_instructions", pa.int64()), ("n_supported", pa.int64()), ("coverage", pa.float64()), ("complete", pa.bool_()), ("flow_valid", pa.bool_()), ("try_catch", pa.list_(pa.struct([("setup", pa.int64()), ("end", pa.int64()), ("catches", pa.list_(pa.struct([("exception_type", pa.string()), ("variable_name", pa.string())])))])))]
            kinds += [("scanned", pa.bool_()), *[(n, pa.int64()) for n in ("length", "consumed", "branches", "invalid_branches", "debug_records")], ("debug_valid", pa.bool_())] if measured else []
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *[pa.array([x[n] for x in rows], t) for n, t in kinds]], [*keys, *[n for n, _ in kinds]])

    source = regions.select(*keys, F.col("region"), F.col("context"))
    schema = ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys)
    return source.mapInArrow(run, f"{schema}, {_PREVIEW}" + f", {_SCAN}" * measured)
