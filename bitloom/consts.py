"""The fixed geometry of a sketch, and the other fixed values."""

#: Register bits, registers, bits of a register, bits of a sketch.
P, M, REG_BITS, TOTAL_BITS = 10, 1024, 32, 32768
BITMAP_BYTES = TOTAL_BITS // 8
SEEDS = (0, 1, 2)
#: The prefixes of content keys.
PREFIXES = "ohrdntvlcu"
PROTOCOL_VERSION, CONTRACT_VERSION = 1, 2
#: Input and output ports of each kind of module.
MODULE_PORTS = {"Slice": (1, 1), "Renorm": (1, 1), "Gate": (1, 1), "Ground": (1, 2), "Experts": (2, 1), "Merge": (2, 1)}
WORD_PATTERN = "[A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY_TREE = "empty-atom-tree"
EMPTY_BITMAP_HEX = "00" * BITMAP_BYTES
EOS = "\0"
