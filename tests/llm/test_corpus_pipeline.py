"""The pipeline's stages in a row against brute force, and lines in scripts without blanks."""
import zlib
from collections import Counter, defaultdict

import zstandard
from pyspark.sql import functions as F

from test_text_operators import deleted_lines, encoded, near_classes, words

from ledgerlens.llm import language, lines


def told(text, learned):
    """Whether the text's language is clear, and whether it is by more than compression settings account for."""
    letters = language.plain(text or "").encode()
    if not any(map(str.isalpha, letters.decode())):
        return False, True
    params = zstandard.ZstdCompressionParameters.from_level(9, source_size=(1 << 18) + (1 << 14), write_content_size=False, write_dict_id=False)
    sizes = []
    for content in learned.values():
        given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdCompressor(dict_data=given, compression_params=params)
        sizes.append(sum(len(press.compress(letters[i:i + (1 << 14)])) for i in range(0, len(letters), 1 << 14)))
    best, second = sorted(sizes)[:2]
    over = second - best - max(1, 0.002 * second)
    return over >= 0, abs(over) > 3


def without(text, gone):
    left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return "" if gone and not left.strip() else left


def leaked(text, items):
    held = words(text)
    sizes = {n for n, _ in items}
    return any((n, tuple(held[i:i + n])) in items for n in sizes for i in range(len(held) - n + 1))


def test_all_stages(spark, sf, tmp_path):
    import corpus_pipeline
    real = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in real.collect()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    top = max(r["doc_id"] for r in rows) + 1
    english = [r["text"] for r in rows if r["lang"] == "en" and len(words(r["text"])) > 60]
    parts = english[3].split(" ")
    again = "this very line of the footer stands below many of the texts"
    item = next(r["text"] for r in bench.collect() if len(words(r["text"])) >= 12)
    made = [english[0], " ".join("changed" if i in (9, 30) else w for i, w in enumerate(parts)), f"{english[4]}\n{again}",
            f"{english[5][:len(english[5]) // 2]}\n{again}\n{english[6][:200]}", again, f"{english[7][:300]} {item} {english[8][:300]}",
            "Съешь же ещё этих мягких французских булок, да выпей чаю.", None, "", "7 8 9", " ".join(english * 3)]
    kind = real.schema
    extra = [{**rows[0], "doc_id": top + i, "text": t, "lang": None} for i, t in enumerate(made)]
    table = spark.createDataFrame([tuple(r[f] for f in kind.names) for r in rows + extra], kind)
    table.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    learned, accepted = language.dictionaries(docs), {r["doc_id"] for r in language.accepted(docs).collect()}
    left = {}
    for r in rows + extra:
        clear, sure = told(r["text"], learned)
        if not sure:
            clear = r["doc_id"] in accepted
        if clear:
            left[r["doc_id"]] = r["text"]
    assert not {top + 6, top + 7, top + 8, top + 9} & set(left) and len(left) > 0.8 * len(rows)
    gone = deleted_lines(set(left.items()))
    assert gone[top + 4] and not any(again in line for line in left[top + 2].split("\n")[:1])
    left = {i: without(t, gone[i]) for i, t in left.items()}
    same = near_classes(left)
    left = {i: t for i, t in left.items() if same[i] == i}
    assert top not in left or left[top] == ""
    items = {(n, tuple(w[i:i + n])) for w in (words(r["text"]) for r in bench.collect()) for n in [min(10, len(w))] if n for i in range(len(w) - n + 1)}
    left = {i: t for i, t in left.items() if not leaked(t, items)}
    assert top + 5 not in left

    want, order = Counter(), sorted(left)
    for doc_id, ids in zip(order, encoded([(i, left[i]) for i in order])):
        ids = ids + [1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            piece = ids[at:at + 4096]
            want[doc_id, k, at, len(piece), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_keep_the_columns_of_documents(spark, sf):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, docs.limit(0)):
            assert stage(spark, table, sf).schema.simpleString() == docs.schema.simpleString()


def test_paragraphs_without_blanks(spark):
    long, short = "敏捷的棕色狐狸跳过懒狗这是一个测试", "测试一下"
    thai = "นี่คือย่อหน้าที่ซ้ำกันในหลายเอกสาร"
    rows = [(1, f"{long}\n{short}\n{thai}"), (2, f"其他\n{long}\n{short}"), (3, f"{thai}\n{short} 中"), (4, f"{short}"), (5, "été à côté là où")]
    frame = spark.createDataFrame(rows + [(6, "été à côté là où")], "doc_id long, text string")
    got = {r["row"]["doc_id"]: r["left_text"] for r in lines.deduplicated(frame).select("row", F.col("left_text")).collect()}
    # The short line goes where it stands in a repeated run that is long enough, and stays alone.
    assert got == {1: rows[0][1], 2: "其他", 3: f"{short} 中", 4: short, 5: rows[4][1], 6: rows[4][1]}
