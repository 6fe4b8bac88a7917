"""Control flow of scanned regions: blocks, edges and exception regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Opcodes with a part in control flow.
RETURN, JUMP_TRUE, JUMP_FALSE, JUMP, POP_TRY, PUSH_TRY, CATCH, THROW = 0x0000, 0x0002, 0x0003, 0x0004, 0x01E6, 0x01E5, 0x01E7, 0x01E8
PUSH_LOCAL_RP = 0x01A9


def blocks(rows: list[dict], length: int) -> tuple[list[dict], list[str]]:
    """Blocks [start, end) of a region's instructions, and targets that are no instructions."""
    errors: list[str] = []
    starts = [r["offset"] for r in rows]
    known = set(starts)
    leaders = set(starts[:1])
    for r, after in zip(rows, [*starts[1:], None], strict=True):
        targets = r["operands"][:1] if r["opcode"] in (JUMP_TRUE, JUMP_FALSE, JUMP) else r["operands"] if r["opcode"] == PUSH_TRY else []
        if (r["opcode"] in (JUMP_TRUE, JUMP_FALSE, JUMP) and not targets) or (r["opcode"] == PUSH_TRY and len(targets) != 2):
            errors.append(f"0x{r['offset']:04X}: wrong number of targets")
        for t in targets:
            if t in known:
                leaders.add(t)
            else:
                errors.append(f"0x{r['offset']:04X}: 0x{t:04X} is no instruction")
        if r["opcode"] in (RETURN, JUMP_TRUE, JUMP_FALSE, JUMP, PUSH_TRY, THROW) and after is not None:
            leaders.add(after)
    order = sorted(leaders)
    return [{"id": i, "start": a, "end": z} for i, (a, z) in enumerate(zip(order, [*order[1:], length], strict=True))], errors


def edges(rows: list[dict], found: list[dict]) -> list[dict]:
    """Distinct edges between blocks: taken, fallthrough, jump. Returns and throws have none."""
    by_start = {b["start"]: b["id"] for b in found}
    last: dict[int, dict] = {}
    k = 0
    for r in rows:
        while k + 1 < len(found) and r["offset"] >= found[k + 1]["start"]:
            k += 1
        last[found[k]["id"]] = r
    out = []
    for i, b in enumerate(found):
        r = last[b["id"]]
        after = found[i + 1]["id"] if i + 1 < len(found) else None
        target = by_start.get(r["operands"][0]) if r["operands"] else None
        if r["opcode"] in (JUMP_TRUE, JUMP_FALSE):
            out += [(b["id"], target, "taken"), (b["id"], after, "fallthrough")]
        elif r["opcode"] == JUMP:
            out.append((b["id"], target, "jump"))
        elif r["opcode"] not in (RETURN, THROW):
            out.append((b["id"], after, "fallthrough"))
    return [{"from": a, "to": z, "kind": kind} for a, z, kind in dict.fromkeys(out) if z is not None]


def exceptions(rows: list[dict]) -> tuple[list[dict], list[str]]:
    """Exception regions: setup, end and handlers (value, catch and guard offsets, variable, body). A
    handler is a push of its variable, a catch and a jump to the next handler, until the end."""
    at = {r["offset"]: i for i, r in enumerate(rows)}
    out, errors = [], []
    for r in rows:
        if r["opcode"] != PUSH_TRY or len(r["operands"]) != 2:
            continue
        handler, end = r["operands"]
        handlers, seen, place = [], set(), handler
        while place != end and place in at and place not in seen:
            seen.add(place)
            three = rows[at[place] : at[place] + 3]
            if len(three) < 3 or [x["opcode"] for x in three] != [PUSH_LOCAL_RP, CATCH, JUMP_FALSE] or not three[0]["operands"]:
                break
            after = rows[at[place] + 3]["offset"] if at[place] + 3 < len(rows) else end
            handlers.append({"value": place, "catch": three[1]["offset"], "guard": three[2]["offset"], "variable": three[0]["operands"][0], "body": after})
            place = three[2]["operands"][0]
        if place != end or end not in at or rows[at[end]]["opcode"] != POP_TRY:
            errors.append(f"0x{r['offset']:04X}: the handlers do not lead to the end")
            continue
        exits = [x["offset"] for x in rows if x["opcode"] == JUMP and x["operands"] and x["operands"][0] == end and r["offset"] < x["offset"] < end]
        out.append({"setup": r["offset"], "handler": handler, "end": end, "handlers": handlers, "exits": exits})
    return out, errors


def control_flow(rows: list[dict], length: int, complete: bool = True) -> dict:
    """blocks, edges, exceptions, errors, valid. An edge leads from each setup to its handlers."""
    if not rows:
        return {"blocks": [], "edges": [], "exceptions": [], "errors": [] if complete else ["incomplete scan"], "valid": complete}
    found, errors = blocks(rows, length)
    links = edges(rows, found)
    regions, wrong = exceptions(rows)
    home = lambda offset: max((b["id"] for b in found if b["start"] <= offset), default=None)
    for x in regions:
        link = {"from": home(x["setup"]), "to": home(x["handler"]), "kind": "exception"}
        if link not in links:
            links.append(link)
    errors += wrong + ([] if complete else ["incomplete scan"])
    return {"blocks": found, "edges": links, "exceptions": regions, "errors": errors, "valid": not errors}


def scaffolding(flow: dict) -> set[int]:
    """Offsets of instructions that only serve exception handling."""
    out: set[int] = set()
    for x in flow["exceptions"]:
        out |= {x["setup"], x["end"], *x["exits"]}
        for h in x["handlers"]:
            out |= {h["value"], h["catch"], h["guard"]}
    return out


def loops(flow: dict) -> list[tuple[int, int]]:
    """(first, last) blocks of each back edge."""
    return [(e["to"], e["from"]) for e in flow["edges"] if e["to"] < e["from"]]


def region_blocks(instructions: DataFrame, keys: list[str], length: str) -> DataFrame:
    """`keys`, block (from 0), start, end, n, and the last instruction's last_opcode and last_target, of instruction rows
    (keys, offset, opcode, operands, and the region's length): as `blocks`, without Python. A region, a function's
    code, is one group; offsets are unique in it. The input is shuffled and sorted once: what jumps aim at stands
    before the instruction of its place, and blocks are told by neighbouring rows, without joins."""
    ends = F.coalesce(F.col("opcode").isin(RETURN, JUMP_TRUE, JUMP_FALSE, JUMP, PUSH_TRY, THROW), F.lit(True))
    jumps = F.col("opcode").isin(JUMP_TRUE, JUMP_FALSE, JUMP)
    aims = F.when(jumps, F.slice("operands", 1, 1)).when(F.col("opcode") == PUSH_TRY, F.col("operands"))
    target = F.when(jumps, F.get("operands", F.lit(0))).cast("long")
    row = lambda place, real: F.struct(place.cast("long").alias("offset"), F.lit(real).alias("_real"), *[F.when(F.lit(real), c).alias(n) for n, c in (("_opcode", F.col("opcode")), ("_target", target), ("_ends", ends), ("_length", F.col(length).cast("long")))])
    both = F.concat(F.array(row(F.col("offset"), True)), F.coalesce(F.transform(aims, lambda x: row(x, False)), F.array()))
    places = instructions.select(*keys, F.explode(both).alias("_x")).select(*keys, "_x.*")
    order = Window.partitionBy(*keys).orderBy("offset", "_real")
    ended = F.last("_ends", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    aimed = F.lag("offset").over(order) == F.col("offset")
    marked = places.withColumn("_leads", F.coalesce(ended, F.lit(True)) | F.coalesce(aimed, F.lit(False))).where("_real")
    own = {"_at": F.row_number().over(order), "_block": F.sum(F.col("_leads").cast("int")).over(order) - 1, "_next": F.lead("offset").over(order), "_last": F.coalesce(F.lead("_leads").over(order), F.lit(True))}
    # A block's first row and its last one, which may be the same, are next to each other here.
    edge = marked.withColumns(own).where("_leads OR _last")
    of_last = lambda c: F.when(F.col("_last"), F.col(c)).otherwise(F.lead(c).over(order))
    found = edge.withColumns({"_end": of_last("_next"), "_n": of_last("_at") - F.col("_at") + 1, "_last_opcode": of_last("_opcode"), "_last_target": of_last("_target")}).where("_leads")
    return found.select(*keys, F.col("_block").cast("int").alias("block"), F.col("offset").alias("start"), F.coalesce("_end", "_length").alias("end"), F.col("_n").cast("long").alias("n"), F.col("_last_opcode").alias("last_opcode"), F.col("_last_target").alias("last_target"))


def region_edges(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, source, target, kind (taken, fallthrough, jump) between the blocks of `region_blocks`, as `edges`. A target
    that is no block's start, or past the last block, has no edge. A jump is put behind the block that starts where it
    aims, in one more sort of the same partitions."""
    two, jumps = F.col("last_opcode").isin(JUMP_TRUE, JUMP_FALSE), F.col("last_opcode").isin(JUMP_TRUE, JUMP_FALSE, JUMP)
    following = F.lead("block").over(Window.partitionBy(*keys).orderBy("start"))
    row = lambda place, target, kind, source: F.struct(place.alias("_place"), target.cast("int").alias("target"), kind.cast("string").alias("kind"), source.cast("int").alias("source"))
    none = F.lit(None)
    start = row(F.col("start"), F.col("block"), none, none)
    jump = row(F.col("last_target"), none, F.when(two, "taken").otherwise("jump"), F.col("block"))
    through = row(F.lit(None).cast("long"), F.col("_following"), F.lit("fallthrough"), F.col("block"))
    goes = ~F.col("last_opcode").isin(JUMP, RETURN, THROW) & F.col("_following").isNotNull()
    every = F.concat(F.array(start), F.when(jumps & F.col("last_target").isNotNull(), F.array(jump)).otherwise(F.array()), F.when(goes, F.array(through)).otherwise(F.array()))
    rows = blocks.withColumn("_following", following).select(*keys, F.explode(every).alias("_x")).select(*keys, "_x.*")
    # A place's start, which has no source, comes first.
    order = Window.partitionBy(*keys).orderBy("_place", F.col("source").asc_nulls_first())
    known = F.last(F.when(F.col("source").isNull(), F.struct("_place", "target")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    met = F.when(F.col("kind") == "fallthrough", F.col("target")).when(known["_place"] == F.col("_place"), known["target"])
    return rows.withColumn("_met", met).where("source IS NOT NULL AND _met IS NOT NULL").select(*keys, "source", F.col("_met").alias("target"), "kind")
