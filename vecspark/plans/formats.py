"""Registered queries over file formats, settings and constants: what is written is read back, and rules are held against SQL.

The vectors are the synthetic ones in steps of 1/64, the weights the golden ones in steps
of 1/1024, which every format holds exactly.
"""

from __future__ import annotations

import json
import struct
from dataclasses import asdict

import numpy as np
from pyspark.sql import functions as F

from ..operators.linear import LinearCodec, default_dim
from ..operators.sampling import STRATEGIES, split
from ..session import materialise, scratch
from ..sources import aqed, csv_vectors, detect, json_vectors, registry, synthetic, weights
from ..sources.config import masked_key, well_formed_key
from ..sources.files import write_bytes
from ..sources.loader import load_embeddings
from . import evaluation
from .catalogue import CODES, DIM, SEED, SMALL, SQL_BOOK, SQL_P, SQL_RHO, SQL_SYNTH, SUBVECTORS, exploded, first_codebook, query, r6, small_codec, vectors
from .cmaes import CMAES
from .training import TrainerConfig

STEP, WEIGHT_STEP = 64, 1024
FILES = ("aqed", "aqed_binary", "json", "json_array", "json_lines", "csv", "parquet")
WEIGHT_FILES = ("aqwt", "aqwt_1", "trainer_json", "flat_json", "flat_raw")


@query(f"""{SQL_SYNTH}, f as (select vec_id, j::int as dim, floor(y / sqrt(sum(y * y) over (partition by vec_id)) * {STEP}) / {STEP} as value from m)
select format, vec_id, dim, value from f, (select unnest({list(FILES)}) as format)""")
def file_round_trips(spark, sf_dir):
    """Every sink, and the loader (format detection included) over what it wrote."""
    df = synthetic.clustered(spark, 16).select("vec_id", F.transform("embedding", lambda x: (F.floor(x * STEP) / STEP).cast("float")).alias("embedding"))
    df, root = materialise(df, "vectors"), scratch(spark, "formats")
    aqed.write_aqed(df, f"{root}/v.aqed")
    json_vectors.write_json(df, f"{root}/v.json")
    json_vectors.write_json(df, f"{root}/array.json", simple=True)
    df.orderBy("vec_id").select(F.to_json(F.struct(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))).alias("value")).write.text(f"{root}/lines")
    csv_vectors.write_csv(df, f"{root}/v.csv")
    df.write.parquet(f"{root}/v.parquet")
    read = {
        "aqed": load_embeddings(spark, f"{root}/v.aqed"), "aqed_binary": aqed.read_aqed_binary(spark, f"{root}/v.aqed"),
        "json": load_embeddings(spark, f"{root}/v.json"), "json_array": load_embeddings(spark, f"{root}/array.json"), "json_lines": json_vectors.read_json_lines(spark, f"{root}/lines").withColumn("vec_id", F.col("id").cast("long")),
        "csv": load_embeddings(spark, f"{root}/v.csv"), "parquet": load_embeddings(spark, f"{root}/v.parquet"),
    }
    out = None
    for name in FILES:
        one = exploded(read[name], "embedding").select(F.lit(name).alias("format"), "vec_id", "dim", F.col("value").cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""with c as (select (id // {DIM})::int as out_idx, (id % {DIM})::int as in_idx from range({SMALL * DIM}) t(id)),
w as (select *, in_idx // 8 as blk from c), x as (select *, case when blk >= out_idx * 8 // {SMALL} and blk < (out_idx + 1) * 8 // {SMALL} then (1 + exp(-(in_idx % 8) / 8.0 * ((1 + sqrt(5)) / 2))) / 2 / (1 + 0.1 * abs(blk - ((out_idx * 8 // {SMALL}) + ((out_idx + 1) * 8 // {SMALL})) / 2.0)) else 0.0 end as raw from w),
y as (select out_idx, in_idx, floor(raw / sum(raw) over (partition by out_idx) * {WEIGHT_STEP}) / {WEIGHT_STEP} as weight from x) select format, out_idx, in_idx, weight from y, (select unnest({list(WEIGHT_FILES)}) as format)""")
def weight_round_trips(spark, sf_dir):
    """Both versions of the binary format, the trainer's document and flat weights."""
    held = np.floor(small_codec().weights * WEIGHT_STEP) / WEIGHT_STEP
    root, codec = scratch(spark, "weights"), LinearCodec.from_flat(held.ravel(), DIM, SMALL)
    weights.save_weights(spark, f"{root}/2.aqwt", weights.BinaryWeights(DIM, SMALL, "text", 0.5, 1.75, held))
    write_bytes(spark, f"{root}/1.aqwt", weights.MAGIC + struct.pack("<BHHBf", 1, DIM, SMALL, 1, 0.5) + held.astype("<f4").tobytes())
    write_bytes(spark, f"{root}/trainer.aqwt", json.dumps({"original_dim": DIM, "compressed_dim": SMALL, "val_score": 0.5, "weights": codec.flat()}).encode())
    weights.save_flat(spark, f"{root}/flat.json", codec)
    weights.save_flat(spark, f"{root}/flat.bin", codec)
    read = [weights.load_weights(spark, f"{root}/{n}.aqwt").codec() for n in ("2", "1", "trainer")] + [weights.load_flat(spark, f"{root}/flat.{n}", DIM, SMALL) for n in ("json", "bin")]
    rows = [(name, k // DIM, k % DIM, w) for name, one in zip(WEIGHT_FILES, read, strict=True) for k, w in enumerate(one.flat())]
    return spark.createDataFrame(rows, "format string, out_idx int, in_idx int, weight double")


@query(f"select {DIM}::int as original_dim, {SMALL}::int as compressed_dim, {DIM / SMALL}::double as ratio, 0.5::double as spearman, 1.75::double as rotation_scale, 'audio' as model_type, {DIM * SMALL}::bigint as n_weights, {18 + 4 * DIM * SMALL}::bigint as size_bytes")
def weights_info(spark, sf_dir):
    return weights.BinaryWeights(DIM, SMALL, "audio", 0.5, 1.75, small_codec().weights).info(spark)


@query(f"{SQL_BOOK} select sub::int as sub, code::int as code, unnest(range(2))::int as dim, round(unnest(c), 6) as value from cb")
def codebook_round_trip(spark, sf_dir):
    path = f"{scratch(spark, 'book')}.json"
    weights.save_codebook(spark, path, first_codebook(spark, sf_dir))
    held = weights.load_codebook(spark, path).centroids
    assert held.shape == (SUBVECTORS, CODES, SMALL // SUBVECTORS)
    return spark.createDataFrame([(*map(int, at), float(x)) for at, x in np.ndenumerate(held)], "sub int, code int, dim int, value double").withColumn("value", r6(F.col("value")))


#: One document of each shape of JSON vectors, and of pairs.
SHAPES = {
    "array": [[1, 2], [3, 4]], "embeddings": {"embeddings": [[1, 2], [3, 4]]}, "vectors": {"vectors": [[1, 2], [3, 4]]},
    "objects": [{"id": "a", "vector": [1, 2], "label": "x"}, {"id": "b", "embedding": [3, 4]}], "two sets": {"embeddings1": [[1, 2]], "embeddings2": [[3, 4]]},
}
PAIR_SHAPES = {
    "flat": {"embeddings1": [[1, 2]], "embeddings2": [[3, 4]], "scores": [0.5]}, "nested": {"pairs": [{"embedding1": [1, 2], "embedding2": [3, 4], "score": 0.5}]},
    "ring": {"embeddings": [[1, 2], [3, 4]]},
}


@query("""select shape, vec_id, case shape when 'objects' then ['a', 'b'][vec_id + 1] when 'two sets' then ['e1_0', 'e2_0'][vec_id + 1] end as id, case shape when 'objects' then ['x', ''][vec_id + 1] end as label, a, b
from (select unnest(['array', 'embeddings', 'vectors', 'objects', 'two sets']) as shape), (values (0::bigint, 1.0::double, 2.0::double), (1, 3.0, 4.0)) t(vec_id, a, b)""")
def json_shapes(spark, sf_dir):
    root, out = scratch(spark, "shapes"), None
    for name, doc in SHAPES.items():
        write_bytes(spark, f"{root}/{name}.json", json.dumps(doc).encode())
        one = load_embeddings(spark, f"{root}/{name}.json").select(F.lit(name).alias("shape"), "vec_id", "id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate("ab")])
        out = one if out is None else out.unionByName(one)
    return out


@query("select * from (values ('flat', 0::bigint, 1.0::double, 3.0::double, 0.5::double), ('nested', 0, 1.0, 3.0, 0.5), ('ring', 0, 1.0, 3.0, null), ('ring', 1, 3.0, 1.0, null)) t(shape, pair_id, a, b, score)")
def pair_shapes(spark, sf_dir):
    root, out = scratch(spark, "pairs"), None
    for name, doc in PAIR_SHAPES.items():
        write_bytes(spark, f"{root}/{name}.json", json.dumps(doc).encode())
        one = json_vectors.read_pairs(spark, f"{root}/{name}.json")
        one = one.select(F.lit(name).alias("shape"), "pair_id", *[F.get(c, F.lit(0)).cast("double").alias(n) for n, c in (("a", "e1"), ("b", "e2"))], F.col("score").cast("double").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


#: First bytes and name of a file.
HEADS = ((b"AQED....", "x.bin"), (b"\x89HDF\r\n\x1a\n", "x"), (b" [1]", "x.csv"), (b"{", "x"), (b"1,2", "x.tsv"), (b"AQED", "x.h5"), (b"", "x.parquet"))


@query("select * from (values (0, 'aqed', 'csv'), (1, 'hdf5', 'csv'), (2, 'json', 'csv'), (3, 'json', 'json'), (4, 'csv', 'csv'), (5, 'hdf5', 'hdf5'), (6, 'parquet', 'parquet')) t(file, scanned, asked)")
def detect_formats(spark, sf_dir):
    rows = [(k, detect.detect(head, name), detect.detect_text(name, head.decode("latin-1"))) for k, (head, name) in enumerate(HEADS)]
    return spark.createDataFrame(rows, "file int, scanned string, asked string")


@query(f"{SQL_P}, f as (select vec_id, v, y from p order by vec_id limit 100), t as (select row_number() over (order by a.vec_id, b.vec_id) as pair_id, list_cosine_similarity(a.v, b.v) as x, list_cosine_similarity(a.y, b.y) as y from f a join f b on a.vec_id < b.vec_id) select rho, case when rho >= 0.95 then 'excellent' when rho >= 0.9 then 'good' else 'poor' end as verdict from ({SQL_RHO})")
def quality_test(spark, sf_dir):
    """The quality test by its definition: all pairs of the first 100 vectors."""
    rho = evaluation.quality_test(vectors(spark, sf_dir), small_codec())
    return spark.createDataFrame([(rho,)], "rho double").select(r6(F.col("rho")).alias("rho"), registry.verdict(F.col("rho")).alias("verdict"))


DIMS = (64, 100, 320, 384, 768, 1024, 1536, 3072)


@query(f"select d::int as original_dim, (ceil(floor(3 * sqrt(d)) / 8) * 8)::int as compressed_dim from (select unnest({list(DIMS)}) as d)")
def default_dims(spark, sf_dir):
    return spark.createDataFrame([(d, default_dim(d)) for d in DIMS], "original_dim int, compressed_dim int")


VARIABLES = (8, 64, 512, 1500)


@query(f"""with n as (select n, 4 + floor(3 * ln(n)) as size from (select unnest({list(VARIABLES)}) as n)), r as (select n, size, ln((size + 1) / 2) - ln(unnest(range(1, (size // 2)::int + 1))) as raw from n),
w as (select n, size, pow(sum(raw), 2) / sum(raw * raw) as mu from r group by n, size), c as (select *, (mu + 2) / (n + mu + 5) as cs, 2 / (pow(n + 1.3, 2) + mu) as c1 from w)
select n::int as n, size::int as population, round(mu, 6) as mu_eff, round((4 + mu / n) / (n + 4 + 2 * mu / n), 6) as c_path, round(cs, 6) as c_sigma, round(c1, 6) as c_one, round(least(1 - c1, 2 * (mu - 2 + 1 / mu) / (pow(n + 2, 2) + mu)), 6) as c_mu,
  round(1 + 2 * greatest(0, sqrt((mu - 1) / (n + 1)) - 1) + cs, 6) as damping, round(sqrt(n) * (1 - 1 / (4.0 * n) + 1 / (21.0 * n * n)), 6) as expected from c""")
def cmaes_constants(spark, sf_dir):
    names = ("mu_eff", "c_path", "c_sigma", "c_one", "c_mu", "damping", "expected")
    made = [CMAES(np.zeros(n), 0.1) for n in VARIABLES]
    out = spark.createDataFrame([(m.n, m.population, *[float(getattr(m, c)) for c in names]) for m in made], "n int, population int, " + ", ".join(f"{c} double" for c in names))
    return out.select("n", "population", *[r6(F.col(c)).alias(c) for c in names])


@query("select * from (values ('instant', 5, 10, 0.1::double, 1), ('quick', 50, 30, 0.1, 3), ('default', 100, 50, 0.1, 3), ('thorough', 200, 100, 0.1, 5)) t(preset, generations, population, sigma, patience)")
def trainer_presets(spark, sf_dir):
    made = {"instant": TrainerConfig.instant(), "quick": TrainerConfig.quick(), "default": TrainerConfig(), "thorough": TrainerConfig.thorough()}
    fields = ("generations", "population", "sigma", "patience")
    return spark.createDataFrame([(name, *[asdict(c)[f] for f in fields]) for name, c in made.items()], "preset string, generations int, population int, sigma double, patience int")


@query("select * from (values ('random', 'random'), ('kmeans', 'kmeans'), ('kmeans++', 'kmeans'), ('k-means', 'kmeans'), ('tsne', 'grid'), ('tsne-grid', 'grid'), ('tsne_grid', 'grid'), ('grid', 'grid')) t(name, strategy)")
def strategy_names(spark, sf_dir):
    return spark.createDataFrame(list(STRATEGIES.items()), "name string, strategy string")


@query(f"with n as (select count(*) as n, greatest(1, least(count(*) - 1, floor(count(*) * 0.2 + 0.5))) as k from embeddings) select vec_id, label, case when row_number() over (order by md5('{SEED}:' || vec_id), vec_id) <= n - k then 'train' else 'validation' end as split from embeddings, n")
def split_with_labels(spark, sf_dir):
    return split(vectors(spark, sf_dir).select("vec_id", "label"), 0.2, SEED)


KEYS = ("", "short", "key_12345678", "key_123456789", "key_live_0123456789", "key_live_01234567890", "other_live_0123456789")


@query(f"select k as key, starts_with(k, 'key_') and length(k) >= 20 as well_formed, case when length(k) <= 12 then repeat('*', length(k)) else k[:8] || '...' || k[-4:] end as masked from (select unnest({list(KEYS)}) as k)")
def key_masks(spark, sf_dir):
    df = spark.createDataFrame([(k,) for k in KEYS], "key string")
    return df.select("key", well_formed_key(F.col("key"), "key_").alias("well_formed"), masked_key(F.col("key")).alias("masked"))
