"""Price tables from price-list documents.

An offer is a JSON document with ``products`` (sku to attributes) and ``terms.OnDemand`` (sku
to terms with price dimensions). Documents are rows ``(region, offer)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OFFER = (
    "products map<string, struct<sku string, productFamily string, attributes map<string,string>>>, "
    "terms struct<OnDemand map<string, map<string, struct<priceDimensions map<string, "
    "struct<pricePerUnit map<string,string>>>>>>>"
)


def _first(values: Column) -> Column:
    return F.get(F.map_values(values), F.lit(0))


def priced_products(offers: DataFrame, offer: str = "offer") -> DataFrame:
    """One row per product: region, family, attributes and its first on-demand price.

    Products and terms are unfolded apart and meet on the sku, so no row carries a whole document. They are merged:
    Spark sizes both sides by the documents' files and would broadcast what is unfolded from them. Both unfold as outer
    rows, without the filter on non-empty documents that would parse each document once more ahead of any repartition.
    """
    parsed = offers.select("region", F.from_json(offer, OFFER).alias("o"))
    products = parsed.select("region", F.explode_outer("o.products").alias("key", "p")).select(
        "region", F.col("p.sku").alias("sku"), F.col("p.productFamily").alias("family"), F.col("p.attributes").alias("a")
    )
    terms = parsed.select("region", F.explode_outer("o.terms.OnDemand").alias("sku", "t")).select(
        "region", "sku", _first(_first(F.col("t"))["priceDimensions"])["pricePerUnit"]["USD"].try_cast("double").alias("price")
    )
    return products.filter(F.col("a").isNotNull()).join(terms.hint("merge"), ["region", "sku"])


def _is(**wanted: str) -> Column:
    cond = F.lit(True)
    for name, value in wanted.items():
        cond = cond & (F.col("family") == value if name == "family" else F.col("a")[name] == value)
    return cond


def instance_prices(products: DataFrame) -> DataFrame:
    """Linux on-demand prices per instance type with cpu, memory in MiB and gpu count."""
    chosen = products.filter(
        F.col("a")["instanceType"].isNotNull()
        & _is(
            servicecode="AmazonEC2",
            capacitystatus="Used",
            operation="RunInstances",
            tenancy="Shared",
            operatingSystem="Linux",
        )
    )
    memory = F.regexp_replace(F.split_part(F.col("a")["memory"], F.lit(" "), F.lit(1)), r"[^0-9.]", "")
    return chosen.select(
        "region",
        F.col("a")["instanceType"].alias("instance_type"),
        F.col("a")["vcpu"].cast("int").alias("cpu"),
        (memory.cast("double") * 1024).cast("long").alias("mem_mi"),
        F.coalesce(F.col("a")["gpu"].try_cast("int"), F.lit(0)).alias("gpu"),
        "price",
    )


def unit_prices(products: DataFrame) -> DataFrame:
    """One price per region for network and classic load balancers, NAT and the control plane."""
    usage = F.col("a")["usagetype"]
    balancer = F.contains(usage, F.lit("LoadBalancerUsage"))
    service = (
        F.when(
            _is(family="Load Balancer-Network", group="ELB:Balancer", operation="LoadBalancing:Network") & balancer, "nlb"
        )
        .when(_is(family="Load Balancer", group="ELB:Balancer", operation="LoadBalancing") & balancer, "elb")
        .when(
            _is(family="NAT Gateway", group="NGW:NatGateway", operation="NatGateway") & F.endswith(usage, F.lit("-Hours")),
            "nat",
        )
        .when(
            _is(family="Compute", servicecode="AmazonEKS", operation="CreateOperation")
            & F.endswith(usage, F.lit("-AmazonEKS-Hours:perCluster")),
            "eks",
        )
    )
    found = products.withColumn("service", service).filter(F.col("service").isNotNull())
    return found.groupBy("region", "service").agg(F.min_by("price", "sku").alias("price"))


def volume_prices(products: DataFrame) -> DataFrame:
    """Per region and volume type: price per GB, and for io1 and gp3 per IOPS and throughput unit
    (quoted per thousand). All come from one pass over the products."""
    kind = F.col("a")["volumeApiName"]
    provisioned = F.col("a")["provisioned"] == "Yes"
    group = F.col("a")["group"]
    storage = (F.col("family") == "Storage") & (kind != "standard")
    iops = provisioned & (group == "EBS IOPS") & (F.col("family") == "System Operation") & kind.isin("io1", "gp3")
    speed = (
        provisioned
        & (group == "EBS Throughput")
        & F.col("family").isin("System Operation", "Provisioned Throughput")
        & (kind == "gp3")
    )
    part = F.when(storage, "gb").when(iops, "iops").when(speed, "throughput")
    prices = (
        products.withColumn("volume_type", kind)
        .withColumn("_part", part)
        .filter(F.col("_part").isNotNull())
        .groupBy("region", "volume_type")
        .agg(*[F.max_by(F.when(F.col("_part") == p, F.col("price")), F.when(F.col("_part") == p, F.col("sku"))).alias(p) for p in ("gb", "iops", "throughput")])
    )
    return prices.filter(F.col("gb").isNotNull()).select(
        "region",
        "volume_type",
        F.col("gb").alias("price_gb"),
        F.coalesce("iops", F.lit(0.0)).alias("price_iops"),
        F.coalesce(F.col("throughput") / 1000, F.lit(0.0)).alias("price_throughput"),
        F.col("volume_type").isin("io1", "gp3").alias("iops_configurable"),
        (F.col("volume_type") == "gp3").alias("throughput_configurable"),
    )
