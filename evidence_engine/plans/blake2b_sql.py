"""BLAKE2b with an 8-byte digest (RFC 7693) as SQL, so that engines without it can check hashed terms."""

from __future__ import annotations

from math import isqrt

# Fixed values of RFC 7693: message schedule (section 2.7), rotations (2.1), primes under the
# initialization vector (2.6), parameter block for 8 bytes, no key, no tree (2.5).
SCHEDULE = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15),
    (14, 10, 4, 8, 9, 15, 13, 6, 1, 12, 0, 2, 11, 7, 5, 3),
    (11, 8, 12, 0, 5, 2, 15, 13, 10, 14, 3, 6, 7, 1, 9, 4),
    (7, 9, 3, 1, 13, 12, 11, 14, 2, 6, 5, 10, 4, 0, 15, 8),
    (9, 0, 5, 7, 2, 4, 10, 15, 14, 1, 11, 12, 6, 8, 3, 13),
    (2, 12, 6, 10, 0, 11, 8, 3, 4, 13, 7, 5, 15, 14, 1, 9),
    (12, 5, 1, 15, 14, 13, 4, 10, 0, 7, 6, 3, 9, 2, 8, 11),
    (13, 11, 7, 14, 12, 1, 3, 9, 5, 0, 15, 4, 8, 6, 2, 10),
    (6, 15, 14, 9, 11, 3, 0, 8, 12, 2, 13, 7, 1, 4, 10, 5),
    (10, 2, 8, 4, 7, 6, 1, 5, 15, 11, 9, 14, 3, 12, 13, 0),
)
ROUNDS = 12
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19)
PARAMETERS = 0x01010008
BLOCK_BYTES = 128

WORD = 2**64
COLUMNS = tuple((i, i + 4, i + 8, i + 12) for i in range(4))
DIAGONALS = tuple((i, (i + 1) % 4 + 4, (i + 2) % 4 + 8, (i + 3) % 4 + 12) for i in range(4))


def _add(*terms: str) -> str:
    total = " + ".join(f"{t}::HUGEINT" for t in terms)
    return f"(({total}) % {WORD}::HUGEINT)::UBIGINT"


def _rotated_xor(x: str, y: str, n: int) -> str:
    mixed = f"xor({x}, {y})"
    return f"(({mixed} >> {n}) | (({mixed} & {2**n - 1}::UBIGINT) << {64 - n}))"


def _swapped(hex_digits: str) -> str:
    pairs = " || ".join(f"substr({hex_digits}, {i}, 2)" for i in range(15, 0, -2))
    return f"('0x' || {pairs})::UBIGINT"


def blake2b_ctes(terms: str, name: str = "blake2b") -> str:
    """CTEs ending in ``name(term, h)`` for a one-column query of terms of at most 128 bytes."""
    start = [isqrt(p << 128) % WORD for p in PRIMES]
    state = [start[0] ^ PARAMETERS, *start[1:], *start]
    size = "octet_length(encode(term))"
    message = ", ".join(f"{_swapped(f'substr(padded, {16 * i + 1}, 16)')} AS m{i}" for i in range(16))
    first = ", ".join(f"{v}::UBIGINT AS v{i}" for i, v in enumerate(state) if i not in (12, 14))
    steps = [
        f"{name}_in AS (SELECT term, CASE WHEN {size} > {BLOCK_BYTES} THEN error('term needs a second block') "
        f"ELSE {size} END AS n, rpad(hex(encode(term)), {2 * BLOCK_BYTES}, '0') AS padded FROM ({terms}))",
        f"{name}_0 AS (SELECT term, {message}, {first}, xor({state[12]}::UBIGINT, n::UBIGINT) AS v12, "
        f"{state[14] ^ (WORD - 1)}::UBIGINT AS v14 FROM {name}_in)",
    ]
    words = [f"m{i}" for i in range(16)]
    for number in range(ROUNDS):
        order = SCHEDULE[number % len(SCHEDULE)]
        for half, quartets in enumerate((COLUMNS, DIAGONALS)):
            for turn, (spin_d, spin_b) in enumerate(((32, 24), (16, 63))):
                sums, mixes = {}, {}
                for q, (a, b, c, d) in enumerate(quartets):
                    word = f"m{order[8 * half + 2 * q + turn]}"
                    total = _add(f"v{a}", f"v{b}", word)
                    sums[a], sums[d] = total, _rotated_xor(f"v{d}", total, spin_d)
                    total = _add(f"v{c}", f"v{d}")
                    mixes[c], mixes[b] = total, _rotated_xor(f"v{b}", total, spin_b)
                for changed in (sums, mixes):
                    values = [f"{changed.get(i, f'v{i}')} AS v{i}" for i in range(16)]
                    source = f"{name}_{len(steps) - 2}"
                    columns = ", ".join(["term", *words, *values])
                    steps.append(f"{name}_{len(steps) - 1} AS (SELECT {columns} FROM {source})")
    digest = f"lpad(lower(to_hex(xor(xor({state[0]}::UBIGINT, v0), v8))), 16, '0')"
    steps.append(
        f"{name} AS (SELECT term, {_swapped('digits')} AS h FROM (SELECT term, {digest} AS digits "
        f"FROM {name}_{len(steps) - 2}))"
    )
    return ",\n".join(steps)
