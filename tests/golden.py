"""Fixed inputs and the results they must give."""

BASELINE = b"def lab_replay_value(x):\n    return x + 1\n"
MODIFIED = (
    b"def lab_replay_value(x):\n    return x + 2\n\n\n"
    b'def lab_replay_marker():\n    return "modified"\n'
)
CALLS = (
    b"def f(): pass\n\nclass A:\n    def f(self):\n        self.f()\n\n"
    b"obj.f()\ng()()\nobj[0].f()\n"
)
# name: (source, nodes, AST, CFG, DFG, CALL)
GRAPHS = {
    "baseline.py": (BASELINE, 10, 9, 9, 0, 0),
    "modified.py": (MODIFIED, 14, 13, 13, 0, 0),
    "sums.py": (b"a = b + c\nd = e + f\n", 19, 18, 18, 0, 0),
    "value.py": (b"value = source + 1\n", 9, 8, 8, 0, 0),
    "printed.py": (b"value = source + 1\nprint(value)\n", 15, 14, 14, 1, 0),
    "self_read.py": (b"x = 1\nx = x + 1\n", 13, 12, 12, 1, 0),
    "augmented.py": (b"x = 1\nx += x\n", 11, 10, 10, 1, 0),
    "calls.py": (CALLS, 34, 33, 33, 0, 3),
    "empty.py": (b"", 1, 0, 0, 0, 0),
}
BROKEN = {
    "open.py": (b"def broken_func(\n    return 1\n", "SyntaxError"),
    "bom.py": (b"\xef\xbb\xbfx = 1\n", "SyntaxError"),
    "nul.py": (b"x = \x00\n", "SyntaxError"),
    "bytes.py": (b"\xff", "UnicodeDecodeError"),
}
HASHES = {
    "baseline.py": "1ebfb627a9d4021a10ddd74fb9f317d9e98c620ff9cdc7a9123fda2b06dba523",
    "modified.py": "80731426ce3a3bec87cf61c7c01778c5034da283613482e14c8af88d5740e0fd",
}
