"""Small constant tables: palettes, threshold maps, colour ramps.

Fixed values (published palettes and matrices) are stated plainly; everything
larger is built from a rule.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The 16 CGA colours.
CGA = [
    (0, 0, 0), (0, 0, 170), (0, 170, 0), (0, 170, 170),
    (170, 0, 0), (170, 0, 170), (170, 85, 0), (170, 170, 170),
    (85, 85, 85), (85, 85, 255), (85, 255, 85), (85, 255, 255),
    (255, 85, 85), (255, 85, 255), (255, 255, 85), (255, 255, 255),
]

# Four-shade handheld greens, light to dark.
GAMEBOY = [(155, 188, 15), (139, 172, 15), (48, 98, 48), (15, 56, 15)]

# Muted handheld greens.
FALLWELL_GREENBOY = [(50, 59, 41), (109, 127, 87), (98, 114, 79), (156, 173, 136)]

# Amber phosphor shades.
PHOSPHOR_AMBER = [(0, 0, 0), (107, 52, 0), (204, 102, 0), (255, 176, 0)]

# Green phosphor shades.
PHOSPHOR_GREEN = [(0, 0, 0), (0, 59, 0), (0, 168, 0), (0, 255, 51)]

# Cream and black.
CREAM = [(22, 18, 16), (236, 218, 176)]

# PICO-8 colours 0..15.
PICO8 = [
    (0, 0, 0), (29, 43, 83), (126, 37, 83), (0, 135, 81),
    (171, 82, 54), (95, 87, 79), (194, 195, 199), (255, 241, 232),
    (255, 0, 77), (255, 163, 0), (255, 236, 39), (0, 228, 54),
    (41, 173, 255), (131, 118, 156), (255, 119, 168), (255, 204, 170),
]

THEMES = {
    "CGA": CGA,
    "CREAM": CREAM,
    "FALLWELL_GREENBOY": FALLWELL_GREENBOY,
    "GAMEBOY": GAMEBOY,
    "PHOSPHOR_AMBER": PHOSPHOR_AMBER,
    "PHOSPHOR_GREEN": PHOSPHOR_GREEN,
    "PICO8": PICO8,
}

# Elevation, depth and heat ramps for contour maps.
CONTOUR_RAMPS = {
    "TOPOGRAPHIC": [(0, 100, 0), (34, 139, 34), (144, 238, 144), (255, 255, 150),
                    (210, 180, 80), (160, 82, 45), (139, 90, 43), (200, 200, 200),
                    (255, 255, 255)],
    "BATHYMETRIC": [(0, 0, 80), (0, 0, 140), (0, 50, 180), (0, 100, 200),
                    (50, 150, 220), (100, 200, 240), (180, 230, 250), (220, 240, 255),
                    (245, 250, 255)],
    "THERMAL": [(0, 0, 50), (20, 0, 100), (80, 0, 140), (160, 0, 100), (220, 60, 20),
                (255, 160, 0), (255, 220, 50), (255, 255, 150), (255, 255, 255)],
}

# False-colour ramps; black-hot is the reverse of white-hot.
IRONBOW = [(0, 0, 0), (20, 0, 80), (80, 0, 120), (160, 0, 100), (220, 60, 20), (255, 180, 0), (255, 255, 100), (255, 255, 255)]
RAINBOW = [(0, 0, 40), (0, 0, 200), (0, 180, 255), (0, 220, 80), (200, 220, 0), (255, 120, 0), (255, 0, 0), (255, 255, 255)]
WHITE_HOT = [(0, 0, 0), (30, 30, 30), (80, 80, 80), (130, 130, 130),
             (180, 180, 180), (220, 220, 220), (255, 255, 255)]
THERMAL_RAMPS = {"IRONBOW": IRONBOW, "RAINBOW": RAINBOW, "WHITE_HOT": WHITE_HOT, "BLACK_HOT": WHITE_HOT[::-1]}


def bayer(n: int) -> list[list[float]]:
    """n x n Bayer matrix (n a power of two) by the usual doubling rule.

    The 8 and 16 wide maps are conventionally laid out transposed.
    """
    m = np.zeros((1, 1))
    while m.shape[0] < n:
        m = np.block([[4 * m, 4 * m + 2], [4 * m + 3, 4 * m + 1]])
    return ((m.T if n >= 8 else m) / (n * n)).tolist()


# Small dispersed, clustered and striped matrices, unscaled.
_SMALL = {
    "BAYER_3X3": ([[0, 7, 3], [6, 5, 2], [4, 1, 8]], 9),
    "DISPERSED_DOT_3X3": ([[0, 6, 3], [4, 7, 2], [5, 1, 8]], 9),
    "CORNER_4X4": ([[0, 2, 5, 9], [1, 4, 8, 12], [3, 7, 11, 14], [6, 10, 13, 15]], 16),
    "BLOCK_VERTICAL_4X4": ([[0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 2, 3], [0, 1, 2, 3]], 4),
    "BLOCK_HORIZONTAL_4X4": ([[0, 0, 0, 0], [1, 1, 1, 1], [2, 2, 2, 2], [3, 3, 3, 3]], 4),
    "HATCH_2X2": ([[0, 1], [1, 0]], 2),
    "HATCH_3X3": ([[0, 1, 2], [1, 2, 1], [2, 1, 0]], 3),
    "HATCH_4X4": ([[0, 1, 2, 3], [1, 2, 3, 2], [2, 3, 2, 1], [3, 2, 1, 0]], 4),
    "ALTERNATE_3X3": ([[0, 5, 1], [6, 2, 7], [3, 8, 4]], 9),
    "PATTERN_5X5": ([[2, 4, 2, 4, 2], [4, 1, 3, 1, 4], [2, 3, 0, 3, 2],
                     [4, 1, 3, 1, 4], [2, 4, 2, 4, 2]], 5),
    "SQUARE_5X5": ([[40, 60, 150, 90, 10], [80, 170, 240, 200, 110],
                    [140, 210, 250, 220, 130], [120, 190, 230, 180, 70],
                    [20, 100, 160, 50, 30]], 255),
}

# Output levels of the maps that do not use one level per cell.
_LEVELS = {"BLOCK_VERTICAL_4X4": 4, "BLOCK_HORIZONTAL_4X4": 4, "HATCH_2X2": 2, "HATCH_3X3": 3,
           "HATCH_4X4": 4, "ALTERNATE_3X3": 9, "PATTERN_5X5": 5}


def map_levels(name: str) -> int:
    return _LEVELS.get(name) or len(threshold_map(name)) ** 2


def hash32(v: np.ndarray) -> np.ndarray:
    """32-bit multiply-xorshift mix (public-domain constants)."""
    x = v.astype(np.uint64) & 0xFFFFFFFF
    x ^= x >> np.uint64(16)
    x = (x * np.uint64(0x7FEB352D)) & np.uint64(0xFFFFFFFF)
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(0x846CA68B)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def white_noise(n: int = 64, seed: int = 0xD17B3D) -> list[list[float]]:
    h = hash32(np.arange(n * n) + seed)
    rank = np.empty(n * n)
    rank[np.lexsort((np.arange(n * n), h))] = np.arange(n * n)
    return (rank / (n * n)).reshape(n, n).tolist()


def blue_noise(n: int = 64, sigma: float = 1.5, seed: int = 42) -> list[list[float]]:
    """Void-and-cluster threshold map (Ulichney 1993), toroidal Gaussian energy."""
    d = np.minimum(np.arange(n), n - np.arange(n)) ** 2
    kernel = np.exp(-(d[:, None] + d[None, :]) / (2 * sigma * sigma))

    def bump(energy, at, sign):
        y, x = divmod(int(at), n)
        energy += sign * np.roll(kernel, (y, x), (0, 1))

    start = max(1, n * n // 10)
    on = np.zeros(n * n, dtype=bool)
    on[np.random.default_rng(seed).permutation(n * n)[:start]] = True
    energy = np.zeros((n, n))
    for at in np.flatnonzero(on):
        bump(energy, at, 1)
    while True:  # relax the first pattern until the tightest cluster is the largest void
        flat = energy.ravel()
        tight = int(np.argmax(np.where(on, flat, -np.inf)))
        on[tight] = False
        bump(energy, tight, -1)
        void = int(np.argmin(np.where(on, np.inf, energy.ravel())))
        on[void] = True
        bump(energy, void, 1)
        if void == tight:
            break
    rank = np.zeros(n * n, dtype=int)
    keep, keep_energy = on.copy(), energy.copy()
    for k in range(start - 1, -1, -1):
        tight = int(np.argmax(np.where(on, energy.ravel(), -np.inf)))
        on[tight] = False
        bump(energy, tight, -1)
        rank[tight] = k
    on, energy = keep, keep_energy
    for k in range(start, n * n):
        void = int(np.argmin(np.where(on, np.inf, energy.ravel())))
        on[void] = True
        bump(energy, void, 1)
        rank[void] = k
    return (rank / (n * n)).reshape(n, n).tolist()


@lru_cache(maxsize=None)
def threshold_map(name: str) -> list[list[float]]:
    """Rows of thresholds in 0..1, addressed [y][x]."""
    if name in ("BAYER_2X2", "BAYER_4X4", "BAYER_8X8", "BAYER_16X16"):
        return bayer(int(name.rsplit("X", 1)[1]))
    if name == "BLUE_NOISE_64X64":
        return blue_noise(64)
    if name == "BLUE_NOISE_16X16":
        return blue_noise(16)
    if name == "WHITE_NOISE_64X64":
        return white_noise(64)
    rows, scale = _SMALL[name]
    return [[v / scale for v in row] for row in rows]
