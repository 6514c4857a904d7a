"""Parsing and walking of JSON bodies inside Arrow-batched Python workers."""

from __future__ import annotations

import json

NOT_JSON = object()


def parse(body):
    """The value of a JSON text, NOT_JSON if it is null or doesn't parse. NaN and infinities are numbers."""
    if body is None:
        return NOT_JSON
    try:
        return json.loads(body)
    except (ValueError, TypeError):
        return NOT_JSON
    except RecursionError:
        return _parse_deep(body)


def _parse_deep(body: str):
    """The same without recursion, for bodies nested deeper than the interpreter's stack."""
    dec, ws = json.JSONDecoder(), " \t\r\n"
    pos, n, stack, root = 0, len(body), [], NOT_JSON

    def skip(p):
        while p < n and body[p] in ws:
            p += 1
        return p

    try:
        while True:  # read one value at pos
            pos = skip(pos)
            c = body[pos]
            if c in "{[":
                value = {} if c == "{" else []
                nxt = skip(pos + 1)
                if body[nxt] == ("}" if c == "{" else "]"):
                    pos = nxt + 1
                else:
                    stack.append([value, None])
                    pos = nxt
                    if c == "{":
                        stack[-1][1], pos = _key(dec, body, pos, skip)
                    continue
            else:
                value, pos = dec.raw_decode(body, pos)
            while True:  # hand the value to its holder
                if not stack:
                    return value if skip(pos) == n else NOT_JSON
                holder = stack[-1]
                if isinstance(holder[0], dict):
                    holder[0][holder[1]] = value
                else:
                    holder[0].append(value)
                pos = skip(pos)
                c = body[pos]
                pos += 1
                if c == ",":
                    if isinstance(holder[0], dict):
                        holder[1], pos = _key(dec, body, skip(pos), skip)
                    break
                if c != ("}" if isinstance(holder[0], dict) else "]"):
                    return NOT_JSON
                value = stack.pop()[0]
    except (ValueError, IndexError):
        return root


def _key(dec, body, pos, skip):
    key, pos = dec.raw_decode(body, pos)
    pos = skip(pos)
    if not isinstance(key, str) or body[pos] != ":":
        raise ValueError("key")
    return key, pos + 1


def kind(value) -> str:
    """number, string, boolean, array, object or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


def canonical(value) -> str:
    """One text for equal values: 1 and 1.0 agree, object keys are sorted, types never mix."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value)
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() else repr(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k)}:{canonical(v)}" for k, v in sorted(value.items())) + "}"


def leaves(value):
    """(path, value) of everything in an object that isn't an object; keys joined by dots, a list is one value."""
    todo = [(None, value)] if isinstance(value, dict) else []
    while todo:
        at, node = todo.pop()
        for k, v in node.items():
            p = k if at is None else f"{at}.{k}"
            if isinstance(v, dict):
                todo.append((p, v))
            else:
                yield p, v


def pointer(parent: str, key) -> str:
    """JSON Pointer (RFC 6901) of a member or element."""
    return f"{parent}/" + (str(key) if isinstance(key, int) else key.replace("~", "~0").replace("/", "~1"))
