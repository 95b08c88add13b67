"""A character-level bidirectional LSTM with CRF transitions, in numpy: training by gradients, batched decoding."""

from __future__ import annotations

import multiprocessing
import unicodedata

import numpy as np

#: Symbols for characters that aren't in the alphabet, by kind.
KINDS = ["<pad>", "<Lu>", "<Ll>", "<Han>", "<Kata>", "<Hira>", "<other letter>", "<digit>", "<punctuation>", "<symbol>", "<space>", "<control>", "<mark>"]


def kind_of(c: str) -> int:
    o = ord(c)
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or o >= 0x20000:
        return 3 if unicodedata.category(c)[0] == "L" else 9
    if 0x30A0 <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9F:
        return 4
    if 0x3041 <= o <= 0x309F:
        return 5
    k = unicodedata.category(c)
    if k in ("Lu", "Lt"):
        return 1
    if k == "Ll":
        return 2
    return {"L": 6, "N": 7, "P": 8, "S": 9, "Z": 10, "C": 11, "M": 12}[k[0]]


class Alphabet:
    """Characters to numbers: those listed have their own, others share that of their base letter or kind."""

    def __init__(self, characters: str):
        self.characters = characters
        self.own = {c: len(KINDS) + i for i, c in enumerate(characters)}
        table = np.zeros(0x10000, dtype=np.int16)
        for o in range(0x10000):
            if not 0xD800 <= o <= 0xDFFF:
                table[o] = self._number(chr(o))
        self.table = table

    def _number(self, c: str) -> int:
        if c in self.own:
            return self.own[c]
        k = kind_of(c)
        if k in (1, 2):
            base = unicodedata.normalize("NFD", c)[0]
            if base in self.own:
                return self.own[base]
        return k

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        out = self.table[np.minimum(codes, 0xFFFF)]
        for i in np.flatnonzero(codes > 0xFFFF):
            out[i] = self._number(chr(codes[i]))
        return out

    @property
    def size(self) -> int:
        return len(KINDS) + len(self.characters)


def _reversed(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Columns of a time-major array, each reversed within its length."""
    at = lengths[None, :] - 1 - np.arange(len(x))[:, None]
    at = np.where(at >= 0, at, np.arange(len(x))[:, None])
    return np.take_along_axis(x, at.reshape(at.shape + (1,) * (x.ndim - 2)), axis=0)


def squash(z: np.ndarray, square: np.ndarray | None = None) -> np.ndarray:
    """A rational tanh, in place: z (27 + z^2) / (27 + 9 z^2) = z (1 + 24 / (3 + z^2)) / 9 between -3 and 3, which is several times as fast."""
    np.clip(z, -3, 3, out=z)
    square = np.multiply(z, z, out=square)
    square += 3
    np.divide(np.float32(24 / 9), square, out=square)
    square += np.float32(1 / 9)
    z *= square
    return z


class Tagger:
    """Parameters: for each direction a table of input gates by character and recurrent weights; output weights; transitions.

    Gates are in the order input, forget, output, candidate; the logistic function is taken as a tanh of the half.
    """

    def __init__(self, alphabet: Alphabet, hidden: int, tags: int, seed: int = 0, parameters: dict[str, np.ndarray] | None = None):
        self.alphabet, self.hidden, self.tags = alphabet, hidden, tags
        if parameters is None:
            r, h = np.random.default_rng(seed), hidden
            parameters = {}
            for d in "fb":
                parameters["T" + d] = r.normal(0, 0.3, (alphabet.size, 4 * h))
                parameters["T" + d][:, h : 2 * h] += 1
                parameters["U" + d] = np.concatenate([np.linalg.qr(r.standard_normal((h, h)))[0] for _ in range(4)], axis=1) * 0.8
            parameters |= {"V": r.normal(0, 0.2, (2 * h, tags)), "b": np.zeros(tags), "A": np.zeros((tags, tags)), "s": np.zeros(tags), "e": np.zeros(tags)}
        self.p = {k: np.ascontiguousarray(v, dtype=np.float32) for k, v in parameters.items()}
        half = np.ones(4 * hidden, dtype=np.float32)
        half[: 3 * hidden] = 0.5
        self.half = half

    # Inference

    def _run(self, x: np.ndarray, d: str) -> np.ndarray:
        """Twice the hidden states of one direction, of a time-major batch of symbols.

        The gates' (1 + tanh) / 2 are kept as 1 + tanh; the halves go into the cells and into the weights that follow.
        """
        h = self.hidden
        table, u = self.p["T" + d] * self.half, self.p["U" + d] * self.half * np.float32(0.5)
        out = np.empty((x.shape[0], x.shape[1], h), dtype=np.float32)
        c = np.zeros((x.shape[1], h), dtype=np.float32)
        state, z = np.zeros_like(c), np.empty((x.shape[1], 4 * h), dtype=np.float32)
        square, new = np.empty_like(z), np.empty_like(c)
        for t in range(x.shape[0]):
            np.dot(state, u, out=z)
            np.take(table, x[t], axis=0, out=square, mode="clip")
            z += square
            squash(z, square)
            np.add(z[:, :h], 1, out=new)
            new *= z[:, 3 * h :]
            z[:, h : 3 * h] += 1
            c *= z[:, h : 2 * h]
            c += new
            c *= 0.5
            state = out[t]
            state[...] = c
            squash(state, new)
            state *= z[:, 2 * h : 3 * h]
        return out

    def emissions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores (time, batch, tag) of a time-major batch, padded at its end."""
        h = self.hidden
        forward = self._run(x, "f")
        backward = self._run(_reversed(x, lengths), "b")
        n = x.shape[0] * x.shape[1]
        v = self.p["V"] * np.float32(0.5)
        shape = (x.shape[0], x.shape[1], self.tags)
        scores = (forward.reshape(n, h) @ v[:h] + self.p["b"]).reshape(shape)
        scores += _reversed((backward.reshape(n, h) @ v[h:]).reshape(shape), lengths)  # the scores are fewer than the states
        return scores

    def certain_zero(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Texts whose best path has tag 0 throughout, without decoding.

        A path leaves tag 0 in runs; a run of n other tags has n + 1 transitions, each of which gains at most g over that of
        tag 0 to itself. Where the scores of all others are lower by more than 2 g everywhere, no run can pay.
        """
        a, s, e = self.p["A"], self.p["s"], self.p["e"]
        g = max(0.0, float((a - a[0, 0]).max()), float((s - s[0]).max()), float((e - e[0]).max()))
        lead = scores[:, :, 0] - scores[:, :, 1:].max(2)
        lead[np.arange(len(scores))[:, None] >= lengths[None, :]] = np.inf
        return lead.min(0) > 2 * g

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best paths (time, batch) of the CRF."""
        steps, n, k = scores.shape
        a = self.p["A"]
        best = scores[0] + self.p["s"]
        back = np.zeros((steps, n, k), dtype=np.int8)
        turned, offsets = np.ascontiguousarray(a.T)[None], np.arange(n * k) * k
        ended = best.copy()
        for t in range(1, steps):
            paths = best[:, None, :] + turned
            from_ = paths.argmax(2)
            back[t] = from_
            best = paths.reshape(-1)[from_.reshape(-1) + offsets].reshape(n, k) + scores[t]
            live = lengths > t
            ended[live] = best[live]
        tag = (ended + self.p["e"]).argmax(1)
        out = np.zeros((steps, n), dtype=np.int8)
        rows = np.arange(n)
        for t in range(steps - 1, -1, -1):
            live = lengths > t
            out[t, live] = tag[live]
            if t:
                tag = np.where(live, back[t, rows, tag], tag)
        return out

    # Training

    def _forward(self, x: np.ndarray, d: str):
        h, n = self.hidden, x.shape[1]
        z_all = self.p["T" + d][x]
        gates, cells, states = np.empty_like(z_all), np.zeros((len(x) + 1, n, h), np.float32), np.zeros((len(x) + 1, n, h), np.float32)
        for t in range(len(x)):
            z = squash((z_all[t] + states[t] @ self.p["U" + d]) * self.half)
            z[:, : 3 * h] = (z[:, : 3 * h] + 1) / 2
            gates[t] = z
            cells[t + 1] = z[:, h : 2 * h] * cells[t] + z[:, :h] * z[:, 3 * h :]
            states[t + 1] = z[:, 2 * h : 3 * h] * squash(cells[t + 1].copy())
        return gates, cells, states

    def _backward(self, x: np.ndarray, d: str, kept, grad_out: np.ndarray, grads: dict) -> None:
        gates, cells, states = kept
        h = self.hidden
        u = self.p["U" + d]
        dz_all, dh, dc = np.empty_like(gates), np.zeros_like(states[0]), np.zeros_like(cells[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g = (gates[t][:, j * h : (j + 1) * h] for j in range(4))
            dh = dh + grad_out[t]
            tc = squash(cells[t + 1].copy())  # its slope is taken as that of tanh
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[:, :h] = dc * g * i * (1 - i)
            dz[:, h : 2 * h] = dc * cells[t] * f * (1 - f)
            dz[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
            dz[:, 3 * h :] = dc * i * (1 - g * g)
            dh, dc = dz @ u.T, dc * f
        grads["U" + d] = np.tensordot(states[:-1], dz_all, axes=([0, 1], [0, 1]))
        flat, ids = dz_all.reshape(-1, 4 * h), x.reshape(-1)
        order = np.argsort(ids, kind="stable")
        used, first = np.unique(ids[order], return_index=True)
        table = np.zeros_like(self.p["T" + d])
        table[used] = np.add.reduceat(flat[order], first, axis=0)
        grads["T" + d] = table

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of a time-major batch and its gradients."""
        h, (steps, n) = self.hidden, x.shape
        kept_f, rx = self._forward(x, "f"), _reversed(x, lengths)
        kept_b = self._forward(rx, "b")
        forward, backward = kept_f[2][1:], _reversed(kept_b[2][1:], lengths)
        v = self.p["V"]
        scores = (forward @ v[:h] + backward @ v[h:] + self.p["b"]).astype(np.float64)
        a, s, e = (self.p[k].astype(np.float64) for k in "Ase")
        rows, last = np.arange(n), lengths - 1
        live = np.arange(steps)[:, None] < lengths[None, :]

        def lse(q, axis):
            m = q.max(axis, keepdims=True)
            return np.log(np.exp(q - m).sum(axis)) + m.squeeze(axis)

        alpha = np.empty_like(scores)
        alpha[0] = s + scores[0]
        for t in range(1, steps):
            alpha[t] = np.where(live[t][:, None], lse(alpha[t - 1][:, :, None] + a[None], 1) + scores[t], alpha[t - 1])
        total = lse(alpha[-1] + e, 1)
        beta = np.empty_like(scores)
        beta[-1] = e
        pair = np.zeros_like(a)
        for t in range(steps - 1, 0, -1):
            step = a[None] + (scores[t] + beta[t])[:, None, :]
            joint = np.exp(alpha[t - 1][:, :, None] + step - total[:, None, None]) * live[t][:, None, None]
            pair += joint.sum(0)
            beta[t - 1] = np.where(live[t][:, None], lse(step, 2), e)
        marginal = np.exp(alpha + beta - total[None, :, None]) * live[:, :, None]
        grad_scores = marginal.copy()
        t_at, b_at = np.nonzero(live)
        np.subtract.at(grad_scores, (t_at, b_at, y[t_at, b_at]), 1)
        gold = scores[t_at, b_at, y[t_at, b_at]].sum() + s[y[0]].sum() + e[y[last, rows]].sum()
        inner = live[1:]
        gold += a[y[:-1][inner], y[1:][inner]].sum()
        np.subtract.at(pair, (y[:-1][inner], y[1:][inner]), 1)
        grad_s, grad_e = marginal[0].sum(0), np.exp(alpha[-1] + e - total[:, None]).sum(0)
        np.subtract.at(grad_s, y[0], 1)
        np.subtract.at(grad_e, y[last, rows], 1)
        grad_scores = grad_scores.astype(np.float32)
        grads: dict[str, np.ndarray] = {"A": pair, "s": grad_s, "e": grad_e, "b": grad_scores.sum((0, 1))}
        grads["V"] = np.concatenate([np.tensordot(forward, grad_scores, axes=([0, 1], [0, 1])), np.tensordot(backward, grad_scores, axes=([0, 1], [0, 1]))])
        self._backward(x, "f", kept_f, grad_scores @ v[:h].T, grads)
        self._backward(rx, "b", kept_b, _reversed(grad_scores @ v[h:].T, lengths), grads)
        return float(total.sum() - gold) / n, {k: (g / n).astype(np.float32) for k, g in grads.items()}

    def fit(self, texts: list[np.ndarray], tags: list[np.ndarray], rounds: int, batch: int = 336, rate: float = 0.012, seed: int = 0, processes: int = 7, say=None) -> None:
        """Adam over batches of texts of like length, shared among processes; the rate falls to a twentieth."""
        pool = multiprocessing.get_context("fork").Pool(processes)
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        w = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, rounds * -(-len(texts) // batch)
        for turn in range(rounds):
            order = np.argsort(np.array([len(t) for t in texts]) + r.uniform(0, 12, len(texts)))
            batches = [order[i : i + batch] for i in range(0, len(order), batch)]
            r.shuffle(batches)
            loss = 0.0
            for chosen in batches:
                shares = [c for c in np.array_split(chosen, processes) if len(c)]
                done = pool.map(_share, [(self, [texts[i] for i in c], [tags[i] for i in c]) for c in shares])
                one = sum(d[0] * len(c) for d, c in zip(done, shares)) / len(chosen)
                grads = {k: sum(d[1][k] * np.float32(len(c) / len(chosen)) for d, c in zip(done, shares)) for k in self.p}
                loss += one / len(batches)
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                now = rate * (1 - 0.95 * step / steps) * min(1.0, 5.0 / max(size, 1e-9)) if size > 5 else rate * (1 - 0.95 * step / steps)
                step += 1
                for k, g in grads.items():
                    m[k] += 0.1 * (g - m[k])
                    w[k] += 0.001 * (g * g - w[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(w[k] / (1 - 0.999**step)) + 1e-8)
            if say:
                say(turn, loss)
        pool.terminate()

    def save(self, path: str) -> None:
        np.savez_compressed(path, characters=np.array([ord(c) for c in self.alphabet.characters], dtype=np.uint32), **{k: v.astype(np.float16) if k[0] in "TU" else v for k, v in self.p.items()})

    def __getstate__(self):
        return {"alphabet": None, "hidden": self.hidden, "tags": self.tags, "p": self.p, "half": self.half}

    @staticmethod
    def load(path: str) -> Tagger:
        with np.load(path) as f:
            p = {k: f[k] for k in f.files if k != "characters"}
            return Tagger(Alphabet("".join(chr(o) for o in f["characters"])), p["Uf"].shape[0], p["V"].shape[1], parameters=p)


def _share(job) -> tuple[float, dict[str, np.ndarray]]:
    """A process's part of a batch."""
    model, texts, tags = job
    lengths = np.array([len(t) for t in texts])
    x, y = np.zeros((lengths.max(), len(texts)), np.int64), np.zeros((lengths.max(), len(texts)), np.int64)
    for j, n in enumerate(lengths):
        x[:n, j], y[:n, j] = texts[j], tags[j]
    return model.gradients(x, y, lengths)
