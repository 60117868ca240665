"""Declared schemas of the study's text tables. Nothing is inferred: like columns then have like types."""

from __future__ import annotations

from pyspark.sql import types as T

#: The seventeen domains of mixture tables, and those of them that have a loss column (fixed names).
DOMAINS = "arxiv freelaw nih_exporter pubmed_central wikipedia_en dm_mathematics github philpapers stackexchange enron_emails gutenberg_pg_19 pile_cc ubuntu_irc europarl hackernews pubmed_abstracts uspto_backgrounds".split()
WITHOUT_LOSS = "nih_exporter philpapers enron_emails europarl".split()
LOSS_DOMAINS = [d for d in DOMAINS if d not in WITHOUT_LOSS]

PROVENANCE = ("reported", "semi_synthetic", "interpolated", "formula", "estimated", "unknown")


def struct(text: str) -> T.StructType:
    """``name type`` pairs, comma separated; names may hold a slash."""
    kinds = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "date": T.DateType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (part.split() for part in text.split(","))])


def mixture() -> T.StructType:
    return struct("index int," + ",".join(f"train_the_pile_{d} double" for d in DOMAINS))


def losses() -> T.StructType:
    return struct("index int," + ",".join(f"metric/the_pile_{d}_val_loss double" for d in LOSS_DOMAINS))


_BRIDGE = "Model string,N_params_B double,D_tokens_B double,Val_Loss double,LB_Average double,LB_IFEval double,LB_BBH double,LB_MATH double,LB_GPQA double,LB_MUSR double,LB_MMLU_PRO double,Loss_Source string,Loss_Comparability string"

#: Kind of table -> schema.
SCHEMAS: dict[str, T.StructType] = {
    "mixture": mixture(),
    "losses": losses(),
    "domain_mapping": struct("mixture_domain string,quality_domain string,mapping_type string,note string"),
    "domain_summary": struct("domain string,source_path string,sample_rows int,sample_bytes_requested long,avg_text_chars double"),
    "scaling": struct("family string,N_params_B double,D_tokens_B double,val_loss double,is_converged int"),
    "published_scaling": struct("family string,N_params_B double,D_tokens_B double,val_loss double,source string,is_converged int"),
    "large_models": struct("model_name string,N_params_B double,D_tokens_B double,FLOPs double,publication_date date,organization string,accessibility string,country string"),
    "quality_grid": struct("experiment_id string,N_params_B double,D_tokens_B double,Q_score double,val_loss double"),
    "trajectory": struct("N_params_B double,D_tokens_B double,val_loss double,step int,interpolated int"),
    "family_files": struct("family string,model_repo string,config_bytes long,readme_bytes long,weight_file_count int,weight_total_bytes long,source_url string,error string"),
    "bridge": struct(_BRIDGE),
    "architecture": struct("model_name string,n_layers int,n_heads int,d_model int,vocab_size int,max_position_embeddings int,training_data_TB double"),
    "manifest": struct("problem string,file string,bytes long,source string,note string"),
}
