"""Command text: word splitting, tokens, hash embedding, classification, variable substitution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

DIM = 384

#: The commands that stand for each category.
EXEMPLARS = {
    "Build": ["cargo build", "cargo build --release", "make", "make all", "gcc -o main main.c", "npm run build", "cmake --build .", "cargo test", "go build ./...", "mvn package", "rustc main.rs"],
    "Deploy": ["kubectl apply -f deployment.yaml", "docker push image:latest", "ansible-playbook deploy.yml", "terraform apply", "helm install my-release chart", "systemctl restart nginx", "scp binary server:/opt/", "docker-compose up -d", "flyctl deploy", "git push origin main"],
    "Debug": ["gdb ./binary", "strace -p 1234", "ltrace ./binary", "dmesg | tail", "journalctl -u service", "perf record -g ./binary", "valgrind ./binary", "tail -f /var/log/syslog", "tcpdump -i eth0", "cargo test -- --nocapture"],
    "Configure": ["vim ~/.bashrc", "export PATH=$PATH:/usr/local/bin", "echo 'alias ll=ls -la' >> ~/.bashrc", "git config --global user.name foo", "chmod 755 script.sh", "chown user:group file", "ln -s /usr/bin/python3 /usr/local/bin/python", "sudo sysctl -w net.core.somaxconn=1024", "systemctl enable nginx", "ufw allow 8080"],
    "Query": ["grep -r pattern .", "find . -name '*.rs'", "rg TODO", "cat /etc/hosts", "ps aux", "df -h", "du -sh *", "top", "htop", "free -m", "netstat -tlnp", "curl http://localhost:8080/health", "wc -l src/*.rs"],
    "Navigate": ["cd /home/user/project", "cd ..", "pushd /tmp", "popd", "ls", "ls -la", "pwd", "tree", "exa -la", "z project"],
}
#: Fixed value: a best average similarity below this is no category.
LEAST_SIMILARITY = 0.05
#: Fixed values: (factor of the byte, factor of its position, weight) of the three hashes of the embedding.
HASHES = ((2654435761, 40503, 1.0), (2246822519, 65599, 0.7), (3266489917, 31, 0.5))

WORDS_TYPE = T.ArrayType(T.StringType())
TOKEN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("append", T.BooleanType())]))
#: What parts words, the operators, and what a backslash escapes inside double quotes.
BLANK, OPERATORS, ESCAPED = " \t\n", "|<>", "\"\\$`"


def shell_words(raw: str) -> list[str]:
    """Words of a command: quotes group, a backslash escapes, and | < > >> are words of their own.

    Inside single quotes all is literal, inside double quotes a backslash stands for itself unless one of ESCAPED follows. An unterminated quote ends
    with the text, an empty quoted string is no word and a trailing backslash outside quotes is dropped.
    """
    words, word, quote, i = [], "", "", 0

    def end() -> None:
        nonlocal word
        if word:
            words.append(word)
        word = ""

    while i < len(raw):
        c = raw[i]
        i += 1
        if quote == "'":
            if c == "'":
                quote = ""
            else:
                word += c
        elif c == "\\" and (not quote or raw[i : i + 1] in (*ESCAPED,)):
            word += raw[i : i + 1]
            i += 1
        elif quote:
            if c == quote:
                quote = ""
            else:
                word += c
        elif c in "'\"":
            quote = c
        elif c in BLANK:
            end()
        elif c in OPERATORS:
            end()
            if raw[i - 1 : i + 1] == ">>":
                c, i = ">>", i + 1
            words.append(c)
        else:
            word += c
    end()
    return words


def tokens(raw: str) -> list[dict]:
    """Kinds of the words: the first, and one after a pipe, is a Command; then a leading - makes a Flag, else Arg."""
    out, first = [], True
    for w in shell_words(raw):
        if w == "|":
            out.append({"kind": "Pipe", "value": None, "append": None})
            first = True
        elif w == "<":
            out.append({"kind": "RedirectIn", "value": None, "append": None})
        elif w in (">", ">>"):
            out.append({"kind": "RedirectOut", "value": None, "append": w == ">>"})
        else:
            out.append({"kind": "Command" if first else "Flag" if w.startswith("-") else "Arg", "value": w, "append": None})
            first = False
    return out


#: Characters and rows of a batch whose words are Python objects at once.
SLICE_CHARS, SLICE_ROWS = 1 << 18, 256


def in_slices(raw: pa.Array, f: Callable[[str], list], kind: T.DataType) -> pa.Array:
    """f of each text, null for null; what it gives goes into Arrow after every few rows, as words take ten times the room of their text in Python."""
    to, out, some, chars = to_arrow_type(kind), [], [], 0
    for r in raw:
        text = r.as_py()
        some.append(None if text is None else f(text))
        chars += len(text or "")
        if chars >= SLICE_CHARS or len(some) >= SLICE_ROWS:
            out.append(pa.array(some, to))
            some, chars = [], 0
    return pa.concat_arrays([*out, pa.array(some, to)])


@arrow_udf(WORDS_TYPE)
def shell_words_udf(raw: pa.Array) -> pa.Array:
    return in_slices(raw, shell_words, WORDS_TYPE)


@arrow_udf(TOKEN_TYPE)
def tokens_udf(raw: pa.Array) -> pa.Array:
    return in_slices(raw, tokens, TOKEN_TYPE)


def embed_numpy(text: str, dim: int = DIM):
    """The hash embedding of one text's UTF-8 bytes as a unit float64 vector (zero for an empty text)."""
    import numpy as np

    b = np.frombuffer(text.encode(), "u1").astype("u8")
    p = np.arange(len(b), dtype="u8")
    out = np.zeros(dim)
    decay = 1 / (1 + 0.01 * p.astype(float))
    for fb, fp, weight in HASHES:
        h = b * np.uint64(fb) + p * np.uint64(fp)
        sign = np.where((h >> np.uint64(32)) & np.uint64(1) == 0, 1.0, -1.0)
        np.add.at(out, (h % np.uint64(dim)).astype(int), sign * decay * weight)
    n = float(out @ out)
    return out / np.sqrt(n) if n > 1.1920929e-07 else out


#: Bytes of text that embed_many() hashes at once.
EMBED_BYTES = 1 << 18


def embed_many(texts: list[str], dim: int = DIM):
    """embed_numpy() of each text as a row, by one pass over the bytes of some texts at a time; the sums add up in the same order."""
    import numpy as np

    data = [t.encode() for t in texts]
    rows, lo = np.zeros((len(data), dim)), 0
    while lo < len(data):
        hi, size = lo + 1, len(data[lo])
        while hi < len(data) and hi - lo < 1024 and size + len(data[hi]) <= EMBED_BYTES:
            size += len(data[hi])
            hi += 1
        n = np.array([len(d) for d in data[lo:hi]])
        b = np.frombuffer(b"".join(data[lo:hi]), "u1").astype("u8")
        row = np.repeat(np.arange(hi - lo), n)
        p = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n)
        decay, cells, parts = 1 / (1 + 0.01 * p.astype(float)), [], []
        for fb, fp, weight in HASHES:
            h = b * np.uint64(fb) + p.astype("u8") * np.uint64(fp)
            cells.append(row * dim + (h % np.uint64(dim)).astype(int))
            parts.append(np.where((h >> np.uint64(32)) & np.uint64(1) == 0, 1.0, -1.0) * decay * weight)
        rows[lo:hi] = np.bincount(np.concatenate(cells), np.concatenate(parts), (hi - lo) * dim).reshape(-1, dim)
        lo = hi
    for r in rows:
        n = float(r @ r)
        if n > 1.1920929e-07:
            r /= np.sqrt(n)
    return rows


@arrow_udf(T.ArrayType(T.FloatType()))
def embed_udf(raw: pa.Array) -> pa.Array:
    """The embedding of each text, made once for the equal texts of a batch."""
    import numpy as np

    d = raw.dictionary_encode()
    v = embed_many(d.dictionary.to_pylist()).astype("f4")
    made = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype="i4") * v.shape[1], v.ravel())
    return made.take(d.indices)


def embed_native(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, idx, weight): the non-zero places of each text's hash embedding, by exploding bytes; no Python."""
    from intentdeck.functions.hashing import bytes_of

    b = df.select(F.col(id_col).alias("id"), F.posexplode(bytes_of(F.col(text_col).cast("binary"))).alias("p", "b"))
    parts = F.array(*[F.struct(((F.col("b") * fb + F.col("p") * fp) % DIM).cast("int").alias("idx"), (F.when(F.shiftright(F.col("b") * fb + F.col("p") * fp, 32).bitwiseAND(1) == 0, w).otherwise(-w) / (1 + 0.01 * F.col("p"))).alias("x")) for fb, fp, w in HASHES])
    put = b.select("id", F.explode(parts).alias("h")).groupBy("id", F.col("h.idx").alias("idx")).agg(F.sum("h.x").alias("x"))
    n = put.groupBy("id").agg(F.sum(F.col("x") * F.col("x")).alias("n"))
    return put.join(n, "id").select("id", "idx", (F.col("x") / F.sqrt("n")).alias("weight"))


def category_scores(text: str) -> dict[str, float]:
    """Average cosine of the text's embedding with each category's exemplars."""
    v = embed_numpy(text)
    return {c: sum(float(v @ embed_numpy(e)) for e in xs) / len(xs) for c, xs in EXEMPLARS.items()}


def _centroids():
    import numpy as np

    return list(EXEMPLARS), np.stack([np.mean([embed_numpy(e) for e in xs], axis=0) for xs in EXEMPLARS.values()])


def classify_text(text: str) -> str:
    """The first category of the best average similarity; Other below LEAST_SIMILARITY."""
    s = category_scores(text)
    best = max(s, key=s.get)
    return best if s[best] >= LEAST_SIMILARITY else "Other"


@pandas_udf(T.StringType())
def classify_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import numpy as np

    names, means = _centroids()  # unit vectors: the average similarity is the similarity with the average

    def one(v):
        s = means @ v
        k = int(np.argmax(s))
        return names[k] if s[k] >= LEAST_SIMILARITY else "Other"

    for b in batches:
        known = b.dropna().unique().tolist()  # equal texts are classified once
        yield b.map(dict(zip(known, map(one, embed_many(known)), strict=True))).astype(object).where(b.notna(), None)


def substitute(text: str, values: dict[str, str]) -> str:
    """${NAME} becomes its value in one pass; unknown names and unclosed braces stay."""
    out, at = "", 0
    while (i := text.find("${", at)) >= 0 and (j := text.find("}", i)) >= 0:
        name = text[i + 2 : j]
        out += text[at:i] + (values[name] if name in values else text[i : j + 1])
        at = j + 1
    return out + text[at:]


def substitute_vars(text, values: dict[str, str]) -> Column:
    """The same as a column expression: the pieces between ${ and } are looked up one by one, values are not scanned again."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,string>")
    pieces = F.split(text, r"\$\{", -1)

    def piece(p):
        j = F.instr(p, "}")
        name = F.substring(p, F.lit(1), j - 1)
        rest = F.substring(p, j + 1, F.length(p))
        return F.when(j == 0, F.concat(F.lit("${"), p)).otherwise(F.concat(F.coalesce(F.element_at(table, name), F.concat(F.lit("${"), name, F.lit("}"))), rest))

    return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), piece), ""))
