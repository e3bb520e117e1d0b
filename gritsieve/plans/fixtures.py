"""Small texts that try every detector, and the queries' other fixed inputs.

Token-like strings are put together here, so that none lies in the repository.
"""

from __future__ import annotations

DASHES = "-" * 5


def _key(kind: str, edge: str = "BEGIN") -> str:
    return f"{DASHES}{edge} {kind}PRIVATE KEY{DASHES}"


def detector_corpus() -> list[tuple[str, str]]:
    """(path, content): for each detector, in order, a text it finds and one it just doesn't."""
    a, b, c, d = "a", "b", "c", "d"
    slack = "-".join(x * 12 for x in "123") + "-" + a * 32
    uuid = "0" * 8 + "-" + a * 4 + "-" + b * 4 + "-" + c * 4 + "-"
    azure = "DefaultEndpointsProtocol={};AccountName=n;AccountKey=k"
    rsa = "RSA "
    pairs = [
        ("AKIA" + "A" * 16, "AKIA" + "A" * 15),
        ("AIza" + a * 35, "AIza" + a * 36),
        ("xoxb-" + slack, "xoxz-" + slack),
        ("GHP_" + a * 36, "ghr_" + a * 36),
        ("eyJa.eyJb.c", "eyJa.b.c"),
        (_key("OPENSSH "), _key("PGP ")),
        (f"x\n{_key('EC ')}\nq\n{_key(rsa, 'END')}\n", f"{_key('')}\nq\n{_key('', 'END')}"),
        ("PWD: x", "pwd x"),
        ("a@b.co", "a@b.c"),
        ("255.999.0.1", "0.1.2.3"),
        ("555-123-4567", " (555) 123-4567"),
        ("4111 1111 1111 1", "4111 1111 1111"),
        ("123-45-6789", "123-456-789"),
        ("Token=" + a * 10, "Token=" + a * 9),
        (f"{DASHES}BEGIN CERTIFICATE{DASHES}", f"{DASHES}BEGIN CERTIFICATE{DASHES[1:]}"),
        ("MySQL://u@h", "postgresql://u@h"),
        (a * 20 + "==", a * 19),
        ("aB" * 24, "aB" * 23 + a),
        ("pk_live_" + a * 10, "rk_live_" + a * 10),
        ("ws_" + a * 10 + "@x.y", "ws_" + a * 9 + "@x.y"),
        ("apikey_test_" + a * 10, "APIKEY_test_" + a * 10),
        ('"' + "a-" * 18 + '"', "'" + "a-" * 18 + "'"),
        ("SK" + "0f" * 16, "SK" + "0g" * 16),
        ("SG." + a * 22 + "." + b * 42, "SG." + a * 22 + "." + b * 41),
        ("key-" + a * 32, "key-" + a * 31),
        ("dop_v1_" + a * 64, "dop_v1_" + "A" * 64),
        (uuid + d * 12, uuid + d * 13),
        ("npm_" + a * 36, "npm_" + a * 35),
        (a * 24 + "." + b * 6 + "." + c * 27, a * 23 + "." + b * 6 + "." + c * 27),
        ("sk-" + a * 50, "sk-proj-" + a * 43),
        (azure.format("https"), azure.format("http")),
        ("mongodb+srv://u:p@h", "MongoDB://u:p@h"),
        ("cloudinary://1:a@b", "cloudinary://a:a@b"),
        (_key(rsa) + "q" + _key(rsa, "END"), _key(rsa) + "\nq\n" + _key(rsa, "END")),
        ("dckr_pat_" + a * 52, "dckr_pat_" + a * 51),
        ("CIRCLE_" + a * 40, "CIRCLE_" + a * 39),
        ("sq0atp-" + a * 22, "sq0atp-" + a * 21),
        ("sq0csp-" + a * 43, "sq0csp-" + a * 42),
        ("ya29.a", "ya29a"),
        ("1234 5678-9012", "1234  5678 9012"),
        ("ABC1234567", "ABCD1234567"),
        ("ABCDE1234F", "ABCDE12345"),
        ("12345678901234", "1234567890123"),
    ]
    return [(f"{i:02d}/{name}.txt", text) for i, pair in enumerate(pairs) for name, text in zip(("found", "missed"), pair)]


def line_corpus() -> list[tuple[str, str]]:
    """Texts that try the rules of lines."""
    texts = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb\rc\r", "a\r\r\nb", "pwd: 1\r\npwd: 2\r", "pwd: 3\n\npwd: 4\n"]
    block = f"{_key('EC ')}\nq\n{_key('EC ', 'END')}"
    return [(f"lines/{i}.txt", t) for i, t in enumerate([*texts, f"\U0001f511\nplain\n{block}\n", block])]


#: Remote, allowed and blocked lists, and whether a push passes.
REMOTES = (
    ("git@github.com:o/r.git", None, None, True),
    ("git@github.com:o/r.git", "github.com", None, True),
    ("git@gitlab.com:o/r.git", "github.com", None, False),
    ("git@github.com:o/r.git", "github.com", "o/r", False),
    ("", "github.com", "o/r", True),
    ("git@github.com:o/r.git", ",", None, False),
    ("git@github.com:o/r.git", "gitlab.com,github.com", "x,,y", True),
    ("git@github.com:o/r.git", " github.com", None, False),
)

EXCLUDES = "src1*/*,*[!0-9][0-4].txt, keep?.md ,src2/**/7*.txt"
EXCLUDES_RE2 = (r"(?s)^src1.*/.*$", r"(?s)^.*[^0-9][0-4]\.txt$", r"(?s)^keep.\.md$", r"(?s)^src2/([^/]+/)*7.*\.txt$")

#: Files as bytes, some of which are no text; and paths that a scan leaves out.
BLOBS = (("plain", b"text"), ("empty", b""), ("zero", b"a\0password=x"), ("latin", b"\x80\x81\x82\xff\xfe"), ("mark", b"\xef\xbb\xbfa"), ("wide", "é日\U0001f511".encode()))
LOGS = ("b.log", "a.log")
