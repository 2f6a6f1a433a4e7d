"""Scanners as data: short programs of a few instructions, run over the text at one place.

A program is a list of (name, argument, target) instructions. The register `state` is what is kept between tokens, as a whole number; `mark` sets how far the
token reaches. A condition that holds goes on with the next instruction, one that fails with its target. Every run ends: a program takes at most `max_steps` steps.
"""

from __future__ import annotations

from collections.abc import Sequence

MAX_STEPS = 10_000
_CLASSES = {"letter": str.isalpha, "digit": str.isdigit, "space": str.isspace, "word": lambda c: c.isalnum() or c == "_", "newline": lambda c: c == "\n"}
#: Tests of (argument, names that may come next, state, character).
CONDITIONS = {
    "require_valid": lambda arg, names, state, char: arg in names,
    "require_state": lambda arg, names, state, char: state == arg,
    "if_char": lambda arg, names, state, char: char == arg,
    "if_range": lambda arg, names, state, char: bool(char) and arg[0] <= char <= arg[1],
    "if_class": lambda arg, names, state, char: bool(char) and _CLASSES[arg](char),
}
OPERATIONS = {"fail", "jump", "set_state", "advance", "mark", "emit", *CONDITIONS}


class VmError(ValueError):
    pass


class VmScanner:
    """Runs a program for each token.

    fail; jump target; set_state n; advance (to the next character, nowhere at the end); mark (the token ends here); emit name; and with a target for when they don't hold: require_valid name;
    require_state n; if_char c; if_range (a, b); if_class name.
    """

    def __init__(self, program: Sequence[tuple], max_steps: int = MAX_STEPS):
        self.program, self.max_steps = [(*p, None, None)[:3] for p in program], max_steps
        if not self.program:
            raise VmError("empty program")
        for i, (op, arg, target) in enumerate(self.program):
            if op not in OPERATIONS:
                raise VmError(f"unknown instruction {op!r} at {i}")
            to = arg if op == "jump" else target
            if (op == "jump" or op in CONDITIONS) and not (isinstance(to, int) and 0 <= to < len(self.program)):
                raise VmError(f"instruction {i} jumps out of the program")
            if op == "if_class" and arg not in _CLASSES:
                raise VmError(f"unknown class {arg!r} at {i}")

    def scan(self, source: bytes, at: int, names: list[str], state: bytes):
        value, place, end, k = int.from_bytes(state, "big"), at, at, 0
        for _ in range(self.max_steps):
            if k >= len(self.program):
                return None
            op, arg, target = self.program[k]
            char, width = self._char(source, place)
            k += 1
            if op in CONDITIONS:
                if not CONDITIONS[op](arg, names, value, char):
                    k = target
            elif op == "fail":
                return None
            elif op == "jump":
                k = arg
            elif op == "set_state":
                value = arg
            elif op == "advance":
                place += width
            elif op == "mark":
                end = place
            else:
                return (arg, end, value.to_bytes(8, "big") if value else b"") if arg in names else None
        return None

    @staticmethod
    def _char(source: bytes, at: int) -> tuple[str, int]:
        if at >= len(source):
            return "", 0
        lead = source[at]
        width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return source[at : at + width].decode("utf-8", "replace")[:1], width
