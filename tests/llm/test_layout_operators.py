import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from firmnet.llm import apportion, chat, packing, warc
from firmnet.llm.queries import ORACLE_SQL
from firmnet.storage import materialize, scratch_path

TOKENIZER, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_ranks_give_the_ids_of_the_tokenizer(docs):
    plain = Tokenizer.from_file(TOKENIZER)
    texts = [r["text"] for r in docs.select("text").collect()]
    texts += ["", " ", "a", " a", "a ", "a  b", "a\n\nb c", "a \nb", "a\tb c", "x <|endoftext|> y", "it's the dog's 12 34!? é 𝒳", "a b c d", "\n", "a b\r\nc d", "²³ ½ x_y"]
    texts += [" ".join(random.Random(i).choices(["a", "the", "", "\n", "x1", "don't", "é,", "<|endoftext|>", "　z"], k=40)) for i in range(200)]
    want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert list(map(packing.Encoder(TOKENIZER, RANKS).encode, texts)) == want


def check_packing(rows, capacity):
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_documents(spark, docs):
    rows = packing.pack(packing.tokenised_pieces(docs, TOKENIZER, RANKS)).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    ids = {r["doc_id"]: [*plain.encode(r["text"], add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == ids.keys()
    for doc, parts in pieces.items():
        parts.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(parts):
            own = ids[doc][at:at + r["length"]]
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(np.array(own, "<u4").tobytes()))
            at += r["length"]
        assert at == len(ids[doc]) and all(r["length"] == 2048 for r in parts[1:])
    n = check_packing(rows, 2048)
    assert n <= 1.002 * sum(map(len, ids.values())) / 2048 + 1


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "x y"), (2, "word " * 7000)], "doc_id long, text string").withColumn("length", F.lit(9))
    rows = packing.pack(packing.tokenised_pieces(df, TOKENIZER)).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows)[:2] == [("1", 1), ("1", 1)]
    assert [r["length"] for r in sorted((r for r in rows if r["doc_id"] == 2), key=lambda r: r["piece"])] == packing.cut_sizes(7002, 2048)
    assert check_packing(rows, 2048) == 4
    assert packing.pack(packing.tokenised_pieces(df.limit(0), TOKENIZER)).count() == 0


def triplets(n, seed=1):
    """Lengths of which three and three fill a bin exactly: best fit decreasing misses many of them."""
    draw, lengths = random.Random(seed), []
    for _ in range(n):
        a = draw.randint(780, 1000)
        b = draw.randint(530, (2048 - a) // 2 + 20)
        lengths += [a, b, 2048 - a - b]
    draw.shuffle(lengths)
    return lengths


def best_fit(lengths):
    return packing.Packing(lengths, 2048).fill(sorted(range(len(lengths)), key=lambda i: -lengths[i])).bins


def check_bins(bins, lengths):
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)


@pytest.mark.parametrize("lengths, saved", [(triplets(60), 5), (triplets(300, 2), 20),
                                            ([random.Random(i).randint(500, 1100) for i in range(500)], 5)])
def test_genetic_search_saves_bins_of_best_fit(lengths, saved):
    one, crossed = packing.evolve(lengths, 2048, 1)
    two, more = packing.evolve(lengths, 2048, 2, [one])
    for bins in (one, two):
        check_bins(bins, lengths)
    assert crossed >= packing.FIRST and more >= packing.FIRST
    assert len(two) <= len(one) <= len(best_fit(lengths)) - saved


def fewest_bins(lengths):
    best = len(lengths)

    def place(k, room):
        nonlocal best
        if len(room) >= best:
            return
        if k == len(lengths):
            best = len(room)
            return
        for b in {r: b for b, r in enumerate(room) if r >= lengths[k]}.values():
            place(k + 1, [r - lengths[k] if i == b else r for i, r in enumerate(room)])
        place(k + 1, [*room, 2048 - lengths[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_small_instances_are_packed_as_well_as_can_be(seed):
    draw = random.Random(seed)
    lengths = [draw.choice((draw.randint(1, 2047), draw.randint(500, 1100))) for _ in range(draw.randint(1, 12))]
    bins, _ = packing.evolve(lengths, 2048, seed)
    check_bins(bins, lengths)
    assert len(bins) == fewest_bins(sorted(lengths, reverse=True))


def test_every_island_crosses_and_sends_its_best_on(spark, docs):
    items = spark.createDataFrame(list(enumerate(triplets(100, 3))), "key long, length long")
    done = packing.islands(items)
    assert done.where(f"crossed < {packing.FIRST}").count() == 0 and done.select("island").distinct().count() == packing.ISLANDS
    assert done.agg(F.min("bins")).first()[0] <= len(best_fit(triplets(100, 3))) - 8
    pieces = packing.tokenised_pieces(docs, TOKENIZER, RANKS).where("length < 2048")
    done = packing.islands(pieces.withColumn("key", F.monotonically_increasing_id()))
    assert done.where(f"crossed < {packing.FIRST}").count() == 0  # on documents, too


def plain_targets(sizes, weights):
    total, level, over = sum(sizes), 0, set()
    while True:
        free = [i for i in range(len(sizes)) if i not in over]
        level = (total - sum(3 * sizes[i] for i in over)) / max(sum(weights[i] for i in free), 1e-9)
        more = {i for i in free if weights[i] * level > 3 * sizes[i]}
        if not more:
            return [3 * s if i in over else w * level for i, (s, w) in enumerate(zip(sizes, weights))]
        over |= more


def test_mixture_of_documents(spark, docs):
    rows = apportion.mix(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by = {}
    for r in rows:
        assert r["_size"] == len([w for w in texts[r["doc_id"]].encode().split()]) and 0 <= r["_taken"] <= 3 * r["_size"]
        by.setdefault(r["source"], []).append(r)
    names = sorted(by)
    sizes = [sum(r["_size"] for r in by[s]) for s in names]
    want = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, size, target in zip(names, sizes, want):
        assert {r["_source_size"] for r in by[s]} == {size} and by[s][0]["_target"] == pytest.approx(target)
        assert abs(sum(r["_taken"] for r in by[s]) - target) <= 2 * rows[0]["_block"]
    again = apportion.mix(docs.repartition(5)).select("doc_id", "_taken").collect()
    assert sorted(again) == sorted((r["doc_id"], r["_taken"]) for r in rows)
    copies = apportion.mixed_documents(docs).collect()
    words = {}
    for r in copies:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert words == {r["doc_id"]: r["_taken"] for r in rows if r["_taken"]}


def test_seats_by_highest_quotients(spark):
    draw = random.Random(2)
    for seats in (0, 1, 7, 100, 1001):
        parties = [(i, draw.choice([0, 1, 5, 30, 200, 7000]), seats, draw.choice([3, 50, 5000])) for i in range(12)]
        room = sum(c for _, v, _, c in parties if v)
        if seats > room:
            continue
        won = [0] * 12
        for _ in range(seats):
            best = max((i for i, v, _, c in parties if v and won[i] < c), key=lambda i: (parties[i][1] / (2 * won[i] + 1), -i))
            won[best] += 1
        df = spark.createDataFrame([p for p in parties], "id long, votes long, seats long, cap long")
        got = {r["id"]: r["quota"] for r in apportion.sainte_lague(df, "votes", "seats", "cap", "id").collect()}
        capped = [i for i in range(12) if won[i] == parties[i][3] < parties[i][1] / max(sum(p[1] for p in parties), 1) * seats]
        if not capped:  # targets never lie above what a source may give
            assert [got[i] for i in range(12)] == won


def test_mixture_edges(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, None, "t"), (None, "x " * 900, None), (3, "", "s"), (4, "w " * 5000, "z")],
                               "doc_id long, text string, source string").withColumn("size", F.lit(1)).withColumn("taken", F.lit(2))
    rows = apportion.mix(df).collect()
    assert len(rows) == 6 and all(0 <= r["_taken"] <= 3 * r["_size"] for r in rows)
    assert {r["source"]: r["_target"] for r in rows}["s"] == 18 and {r["source"]: r["_target"] for r in rows}["t"] == 0
    assert apportion.mix(df.limit(0)).count() == 0 and apportion.mixed_documents(df.limit(0)).count() == 0
    assert apportion.mix(df.where("text is null or text = ''")).where("_taken > 0").count() == 0


def test_archives_round_trip(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    long = "<p>" + "same payload " * 20
    extra = [(10_000 + i, f"http://h/{i}", long) for i in range(40)] + [(3, "http://x", long)] + [(20_000, "u", None), (20_001, None, "short"), (20_002, "v\r\nw", "short"),
             (None, "n", "nothing"), (None, "n2", long), (20_003, "u", long), (20_003, "u", long)]
    both = pages.unionByName(spark.createDataFrame(extra, pages.schema)).repartition(6)
    folders = [scratch_path(spark, "warc") for _ in range(2)]
    manifests = [warc.write_archives(df, f, shard_bytes=200_000, file_bytes=20_000) for df, f in zip((both, both.repartition(3)), folders)]
    files = [sorted((r["final"], r["records"], r["sha256"]) for r in m.collect()) for m in manifests]
    assert files[0] == files[1] and len(files[0]) > 5
    rows = warc.read_archives(spark, folders[0]).collect()
    want = {(r["page_id"], r["url"]): r["html"] or "" for r in both.collect()}
    assert len(rows) == both.count()
    for r in rows:
        url = r["url"].replace("%0D", "\r").replace("%0A", "\n") if r["url"] else r["url"]
        body = want[r["page_id"], url].encode()
        assert r["payload_bytes"] == len(body) and (r["record_type"] == "revisit" or r["payload"] == body)
    same = [r for r in rows if r["payload_bytes"] == len(long)]
    assert sorted((r["record_type"], r["refers_to"]) for r in same if r["record_type"] == "response") == [("response", None)]
    assert all(r["refers_to"] == 3 for r in same if r["record_type"] == "revisit") and len(same) == 44
    assert warc.read_archives(spark, _written(spark, both.limit(0))).count() == 0


def _written(spark, df):
    folder = scratch_path(spark, "warc")
    warc.write_archives(df, folder)
    return folder


def test_archives_equal_sql(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    got = warc.read_archives(spark, _written(spark, pages), payloads=False).drop("url").collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op5_warc_writer']})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want)


def plain_cost(roles):
    """Cheapest repair by trying, turn by turn, every role, merge and insertion from every state."""
    states = {0: 0.0}
    legal = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}

    def gaps(a, b):  # fewest empty turns between a and b
        if (a, b) in legal:
            return 0
        return 1 if any((a, m) in legal and (m, b) in legal for m in (1, 2, 3)) else 99

    for r in roles:
        after = {}
        for a, c in states.items():
            for b in (1, 2, 3):
                own = c + chat.relabel_cost(r, b)
                ways = [own + chat.INSERT * gaps(a, b)] if gaps(a, b) < 99 else []
                ways += [own + chat.MERGE] if a == b else []
                for w in ways:
                    after[b] = min(after.get(b, 1e9), w)
        states = after
    return min(c + chat.INSERT * {0: 0, 1: 2, 2: 1, 3: 0}[s] for s, c in states.items())


def test_repairs_cost_least_and_are_legal(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 3)
    draw = random.Random(4)
    roles = ["system", "user", "assistant", "User ", "tool", None]
    rows, own = [], {}
    for c in range(60):
        own[c] = [draw.choice(roles) for _ in range(draw.randint(1, 14))]
        rows += [(c, t, r, draw.choice(["x", "", None, f"t{t}"])) for t, r in enumerate(own[c])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumn("cost", F.lit("x"))
    got = {}
    for r in sorted(chat.format_chats(df).collect(), key=lambda r: (r["conv_id"], r["place"], r["part"])):
        got.setdefault(r["conv_id"], []).append(r)
    assert got.keys() == own.keys()
    for c, parts in got.items():
        assert parts[0]["cost"] == pytest.approx(plain_cost(own[c]))
        paid, said = 0.0, []
        kept = iter(own[c])
        for r in parts:
            if r["action"] == "insert":
                paid += chat.INSERT
            else:
                paid += chat.relabel_cost(next(kept), chat.ROLES.index(r["role"]) + 1) + chat.MERGE * ("merge" in r["action"])
            if "merge" in r["action"]:
                assert said[-1] == r["role"]
            else:
                said.append(r["role"])
        assert paid == pytest.approx(parts[0]["cost"]) and next(kept, "end") == "end"
        if said[0] == "system":
            said = said[1:]
        assert said == ["user", "assistant"] * (len(said) // 2)
        text = "".join(r["rendered"] for r in parts)
        assert text.count("<|im_start|>") == text.count("<|im_end|>\n") == len([r for r in parts if "merge" not in r["action"]])
        assert text.startswith("<|im_start|>") and text.endswith("<|im_end|>\n")


def test_chat_edges(spark):
    df = spark.createDataFrame([(1, None, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "user", "p"), (None, 0, "user", "q")],
                               "conv_id long, turn long, role string, text string")
    rows = sorted(chat.format_chats(df).collect(), key=lambda r: (str(r["conv_id"]), r["place"], r["part"]))
    assert [(r["action"], r["text"]) for r in rows if r["conv_id"] == 1] == [("keep", "a"), ("merge", "a"), ("keep", "b")]
    assert sum(r["conv_id"] is None for r in rows) == 4
    assert chat.format_chats(df.limit(0)).count() == 0


def test_one_id_or_row_on_most_places_is_spread_over_shards(spark):
    rows = [(7, "same words here " * 4, "a") if i % 5 else (i, f"w{i} " * 9, "a") for i in range(20_000)]
    rows = [(7, f"other {i} text " * 3, s) if i % 7 == 0 else (d, t, s) for i, (d, t, s) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    laid = apportion._laid(df, "doc_id", "text", "source", 7)
    sizes = materialize(laid.groupBy("_blocks", "_phase").count(), "shards").collect()  # a shard has its own phase
    mean = len(rows) / len(sizes)
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 2 * mean


def test_mixing_keeps_columns_of_any_name(spark, docs):
    odd = docs.limit(40).withColumns({c: F.lit(c) for c in ("_size", "_source", "_row", "_at", "_deal", "_no", "_shard", "_target", "key")})
    plain = {r["doc_id"]: r["_taken"] for r in apportion.mix(docs.limit(40)).collect()}
    assert {r["doc_id"]: r["_taken"] for r in apportion.mix(odd).collect()} == plain
    mixed = apportion.mixed_documents(odd)
    assert mixed.columns == odd.columns and {tuple(r)[-9:] for r in mixed.collect()} == {("_size", "_source", "_row", "_at", "_deal", "_no", "_shard", "_target", "key")}


def test_shards_are_cut_by_bytes_and_written_by_one_task_each(spark):
    rows = [(i, f"http://h.org/{i}", "x" * (20_000 if i < 40 else 200) + str(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(df, scratch_path(spark, "warc"), shard_bytes=100_000, file_bytes=1 << 20)
    shards = {}
    for r in manifest.collect():
        shards.setdefault(r["final"].split("-")[1], []).append(r["records"])
    assert len(shards) >= 9 and all(len(files) == 1 for files in shards.values())
    assert sorted(n for files in shards.values() for n in files)[0] <= 6  # a few large pages fill a shard
    attempts = {r["temporary"].split("/")[1].split("-")[0] for r in manifest.collect()}
    assert len(attempts) == len(shards)  # a task of its own each
