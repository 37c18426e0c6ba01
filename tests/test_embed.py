import json
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from quillsearch.embed import providers
from quillsearch.embed.bpe import Tokenizer, byte_characters
from quillsearch.embed.gguf import Gguf
from quillsearch.embed.model import Model, rms


def test_bpe():
    tokens = ["a", "b", "c", "ab", "abc", "bc", "<|end|>", "<|endless|>", "Ġ"]
    t = Tokenizer(tokens, ["b c", "a b", "ab c"], end=99)
    assert t.encode("abc") == [0, 5, 99]  # b c merges first, a bc never does
    assert t.encode("ab c") == [3, 8, 2, 99]
    assert t.encode("a<|endless|>b<|end|>x") == [0, 7, 1, 6, 99]  # x is unknown
    assert t.encode("") == [99]
    assert len(set(byte_characters())) == 256


def naive(t, text):
    s = [t.characters[b] for b in text.encode()]
    while True:
        best = min(((t.ranks[p], i) for i, p in enumerate(zip(s, s[1:])) if p in t.ranks), default=None)
        if best is None:
            return s
        s[best[1] : best[1] + 2] = ["".join(s[best[1] : best[1] + 2])]


def test_bpe_against_the_plain_loop():
    rng = np.random.default_rng(0)
    merges = ["a a", "b a", "aa b", "aa aa", "ba ba", "a b"]
    t = Tokenizer([], merges)
    for _ in range(300):
        text = "".join(rng.choice(list("ab"), rng.integers(0, 20)))
        assert t.merge(text) == naive(t, text)


def string(s):
    return struct.pack("<Q", len(s.encode())) + s.encode()


def write(path, meta, tensors):
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(meta))
    for key, (kind, value) in meta.items():
        head += string(key) + struct.pack("<I", kind)
        if kind == 8:
            head += string(value)
        elif kind == 9:
            head += struct.pack("<IQ", 8, len(value)) + b"".join(map(string, value))
        else:
            head += struct.pack({4: "<I", 6: "<f"}[kind], value)
    body = b""
    for name, (array, kind) in tensors.items():
        body += b"\0" * (-len(body) % 32)
        head += string(name) + struct.pack("<I", array.ndim) + struct.pack(f"<{array.ndim}Q", *array.shape[::-1]) + struct.pack("<IQ", kind, len(body))
        flat = array.astype("<f4").ravel()
        if kind == 0:
            body += flat.tobytes()
        elif kind == 1:
            body += flat.astype("<f2").tobytes()
        elif kind == 30:
            body += (flat.view(np.uint32) >> 16).astype("<u2").tobytes()
        else:
            for b in flat.reshape(-1, 32):
                d = np.float16(max(abs(b).max() / 127, 1e-6))
                body += d.tobytes() + np.round(b / np.float32(d)).clip(-127, 127).astype("i1").tobytes()
    path.write_bytes(head + b"\0" * (-len(head) % 32) + body)


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    rng = np.random.default_rng(3)
    h, heads, kv, d, ff = 32, 2, 1, 16, 32
    meta = {"general.architecture": (8, "qwen3"), "tokenizer.ggml.tokens": (9, ["a", "b", "ab", "<|x|>"]), "tokenizer.ggml.merges": (9, ["a b"]), "tokenizer.ggml.eos_token_id": (4, 3), "qwen3.rope.freq_base": (6, 10000.0)}
    for key, v in {"block_count": 1, "embedding_length": h, "attention.head_count": heads, "attention.head_count_kv": kv, "attention.head_dim": d, "feed_forward_length": ff}.items():
        meta[f"qwen3.{key}"] = (4, v)
    m = lambda *s: rng.standard_normal(s).astype(np.float32) / 4
    tensors = {"token_embd.weight": (m(4, h), 8), "output_norm.weight": (m(h) + 1, 0), "blk.0.attn_norm.weight": (m(h) + 1, 1), "blk.0.ffn_norm.weight": (m(h) + 1, 30), "blk.0.attn_q_norm.weight": (m(d) + 1, 0), "blk.0.attn_k_norm.weight": (m(d) + 1, 0), "blk.0.attn_q.bias": (m(heads * d), 0)}
    for name, shape in {"attn_q": (heads * d, h), "attn_k": (kv * d, h), "attn_v": (kv * d, h), "attn_output": (h, heads * d), "ffn_gate": (ff, h), "ffn_up": (ff, h), "ffn_down": (h, ff)}.items():
        tensors[f"blk.0.{name}.weight"] = (m(*shape), 8)
    path = tmp_path_factory.mktemp("gguf") / "m.gguf"
    write(path, meta, tensors)
    return str(path), tensors


def test_gguf(file):
    g = Gguf(file[0])
    for name, (array, kind) in file[1].items():
        assert np.abs(g.tensor(name) - array).max() < {0: 1e-9, 1: 2e-3, 30: 2e-2, 8: 1e-2}[kind], name
    assert np.array_equal(g.row("token_embd.weight", 2), g.tensor("token_embd.weight")[2])
    with pytest.raises(IndexError):
        g.row("token_embd.weight", 9)


def test_model(file):
    """Against a token-by-token pass in plain loops."""
    model = Model(file[0])
    ids = model.tokenizer.encode("abb")
    assert ids == [2, 1, 3]
    w, eps = model.weight, 1e-6
    x = np.stack([w("token_embd.weight")[i] for i in ids])

    def rope(v, pos):
        out = v.copy()
        for i in range(8):
            a = pos / 10000.0 ** (2 * i / 16)
            out[i], out[i + 8] = v[i] * np.cos(a) - v[i + 8] * np.sin(a), v[i + 8] * np.cos(a) + v[i] * np.sin(a)
        return out

    n = [rms(v, w("blk.0.attn_norm.weight"), eps) for v in x]
    q = [[rope(rms((w("blk.0.attn_q.weight") @ v + w("blk.0.attn_q.bias"))[16 * k : 16 * k + 16], w("blk.0.attn_q_norm.weight"), eps), p) for k in range(2)] for p, v in enumerate(n)]
    k = [rope(rms(w("blk.0.attn_k.weight") @ v, w("blk.0.attn_k_norm.weight"), eps), p) for p, v in enumerate(n)]
    v = [w("blk.0.attn_v.weight") @ u for u in n]
    out = []
    for p in range(3):
        mixed = []
        for head in range(2):
            s = np.array([q[p][head] @ k[j] / 4 for j in range(p + 1)])
            e = np.exp(s - s.max())
            mixed.append(sum(a * b for a, b in zip(e / e.sum(), v)))
        y = x[p] + w("blk.0.attn_output.weight") @ np.concatenate(mixed)
        z = rms(y, w("blk.0.ffn_norm.weight"), eps)
        gate = w("blk.0.ffn_gate.weight") @ z
        out.append(y + w("blk.0.ffn_down.weight") @ (gate / (1 + np.exp(-gate)) * (w("blk.0.ffn_up.weight") @ z)))
    last = rms(out[-1], w("output_norm.weight"), eps)
    assert np.allclose(model.embed("abb"), last / np.linalg.norm(last), atol=1e-5)
    assert np.allclose(providers.provider(path=file[0])(["abb"])[0], model.embed("abb"))
    assert providers.provider(path="/none") is None and providers.provider() is None


def test_api():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            got = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            texts = got["input"]
            data = [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(texts)][::-1]
            if texts[0] == "few":
                data = data[:-1]
            body = json.dumps({"error": {"message": "bad key"}} if self.headers["Authorization"] != "Bearer k" else {"data": data}).encode()
            self.send_response(401 if self.headers["Authorization"] != "Bearer k" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    http = HTTPServer(("localhost", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://localhost:{http.server_address[1]}/v1/embeddings"
    assert providers.Api(url, key="k")(["a", "bbb"]) == [[1.0], [3.0]]
    with pytest.raises(RuntimeError, match="bad key"):
        providers.Api(url)(["a"])
    with pytest.raises(RuntimeError, match="1 embeddings for 2"):
        providers.Api(url, key="k")(["few", "b"])
    http.shutdown()


def test_hashed():
    a, b = providers.Hashed(8)(["x y", ""])
    assert abs(sum(v * v for v in a) - 1) < 1e-9 and b == [0.0] * 8
