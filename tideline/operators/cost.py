"""Prices, capacity and cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.numeric import ieee_div

# Resources reserved on each node for system pods.
RESERVED_CPU_M = 260
RESERVED_MEM_MI = 350
RESOURCES = ["cpu_m", "mem_mi", "gpu", "inf"]


def spot_price(history: DataFrame, keys: Sequence[str] = ("instance_type",), price: str = "price") -> DataFrame:
    """Lowest quoted price per type; quotes that are no numbers count nothing, and a lowest
    price of zero or less is no price."""
    low = F.min(F.col(price).try_cast("double"))
    return (
        history.groupBy(*keys).agg(low.alias("_low")).select(*keys, F.when(F.col("_low") > 0, F.col("_low")).alias("price"))
    )


def price_nodes(nodes: DataFrame, on_demand: DataFrame, spot: DataFrame) -> DataFrame:
    """Hourly price of each node: spot nodes take the spot price if there is one, else on-demand.

    Both price tables have one row per instance type; Spark broadcasts them by their size.
    """
    od = on_demand.select("instance_type", F.col("price").alias("on_demand_price"))
    sp = spot.select("instance_type", F.col("price").alias("_spot"))
    priced = nodes.join(od, "instance_type", "left").join(sp, "instance_type", "left")
    price = F.when(F.col("is_spot"), F.coalesce(F.nullif("_spot", F.lit(0.0)), "on_demand_price")).otherwise(
        F.col("on_demand_price")
    )
    return priced.withColumn("price", price).drop("_spot")


def node_capacity(nodes: DataFrame, pods: DataFrame) -> DataFrame:
    """Per node: replicas, enqueuers, what is available, what users can have and have asked for.

    ``pods``: node_id, phase, is_api, is_enqueuer and the resources. Finished pods do not
    count. Pods are summed up per node before the join, so a crowded node costs nothing.
    """
    resources = [r for r in RESOURCES if r in nodes.columns]
    live = pods.filter(~F.col("phase").isin("Succeeded", "Failed") & F.col("node_id").isNotNull())
    is_api = F.col("is_api")
    sums = live.groupBy("node_id").agg(
        F.count_if(is_api & ~F.col("is_enqueuer")).alias("n_replicas"),
        F.count_if(is_api & F.col("is_enqueuer")).alias("n_enqueuers"),
        *[F.sum(r).alias(f"_all_{r}") for r in resources],
        *[F.sum(F.when(is_api, F.col(r)).otherwise(0)).alias(f"_api_{r}") for r in resources],
    )
    joined = nodes.join(sums, "node_id", "left")

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    columns = [zero("n_replicas").alias("n_replicas"), zero("n_enqueuers").alias("n_enqueuers")]
    for r in resources:
        everything, api = zero(f"_all_{r}"), zero(f"_api_{r}")
        columns += [
            (F.col(r) - everything).alias(f"available_{r}"),
            (F.col(r) - (everything - api)).alias(f"user_capacity_{r}"),
            api.alias(f"user_requested_{r}"),
        ]
    return joined.select("node_id", *columns)


def pending_replicas(pods: DataFrame) -> DataFrame:
    """Number of unfinished API pods on no node."""
    waiting = ~F.col("phase").isin("Succeeded", "Failed") & F.col("node_id").isNull() & F.col("is_api")
    return pods.agg(F.count_if(waiting).alias("n_pending"))


def pods_fit(nodes: DataFrame, pods: DataFrame, max_pods: str = "max_pods") -> DataFrame:
    """For each pod, how many like it fit on its node: the scarcest requested resource decides,
    up to the node's pod limit; resources the pod does not ask for are ignored."""
    resources = [r for r in RESOURCES if r in nodes.columns and r in pods.columns]
    reserved = {"cpu_m": RESERVED_CPU_M, "mem_mi": RESERVED_MEM_MI}
    room = nodes.select("node_id", F.col(max_pods).cast("long").alias("_max"), *[F.col(r).alias(f"_{r}") for r in resources])
    fits = [
        F.when(F.col(r) > 0, ((F.col(f"_{r}") - reserved.get(r, 0)) / F.col(r)).cast("long")) for r in resources
    ]
    joined = pods.join(room, "node_id")
    return joined.withColumn("fits", F.least(F.col("_max"), *fits)).drop("_max", *[f"_{r}" for r in resources])


def cost_breakdown(priced_nodes: DataFrame, fitted_pods: DataFrame, system_price: float = 0.0) -> DataFrame:
    """Cost of the cluster, of its system part, and of each API and kind of API.

    ``priced_nodes``: node_id, price, workload. ``fitted_pods`` (of :func:`pods_fit`): node_id,
    api_name, kind, fits. A pod costs its node's price over the pods that would fit; API and
    kind costs are scaled to sum to the workload's cost. One row per ``scope, component``.
    """
    totals = priced_nodes.agg(
        (F.sum("price") + F.lit(system_price)).alias("total"),
        (F.coalesce(F.sum(F.when(~F.col("workload"), F.col("price"))), F.lit(0.0)) + F.lit(system_price)).alias("system"),
    )
    price = priced_nodes.filter("workload").select("node_id", F.col("price").alias("_price"))
    pod_costs = fitted_pods.join(price, "node_id").withColumn("_cost", ieee_div(F.col("_price"), F.col("fits")))
    shares = (
        pod_costs.groupingSets([["api_name"], ["kind"], []], "api_name", "kind")
        .agg(F.sum("_cost").alias("cost"), F.grouping_id().alias("_level"))
        .select(
            F.when(F.col("_level") == 1, "api").when(F.col("_level") == 2, "kind").otherwise("all").alias("scope"),
            F.coalesce("api_name", "kind").alias("component"),
            "cost",
        )
    )
    everything = shares.filter("scope = 'all'").select("cost").scalar()
    workload = totals.select(F.col("total") - F.col("system")).scalar()
    ratio = F.when(everything > 0, workload / everything).otherwise(1.0)
    scaled = shares.filter("scope <> 'all'").select("scope", "component", (F.col("cost") * ratio).alias("cost"))
    fixed = totals.select(
        F.explode(
            F.array(
                F.struct(F.lit("total").alias("scope"), F.lit("cluster").alias("component"), F.col("total").alias("cost")),
                F.struct(F.lit("system").alias("scope"), F.lit("system").alias("component"), F.col("system").alias("cost")),
            )
        ).alias("r")
    ).select("r.*")
    return fixed.unionByName(scaled)


def instance_inventory(priced_nodes: DataFrame) -> DataFrame:
    """Workload nodes by type and spot, with a total row (null type): count, prices, savings."""
    rows = priced_nodes.filter("workload").withColumn("instance_type", F.coalesce("instance_type", F.lit("unknown")))
    return (
        rows.groupingSets([["instance_type", "is_spot"], []], "instance_type", "is_spot")
        .agg(
            F.count(F.lit(1)).alias("n_nodes"),
            F.sum("price").alias("total_price"),
            F.sum("on_demand_price").alias("total_on_demand"),
        )
        .withColumn("savings", F.col("total_on_demand") - F.col("total_price"))
    )


def min_capacity(metadata: DataFrame, nodes: DataFrame, previous: DataFrame) -> DataFrame:
    """Smallest known memory per instance type in use (those in ``metadata``); zero is unknown."""
    wanted = metadata.select("instance_type").distinct()
    known = metadata.select("instance_type", "mem_mi")
    for other in (nodes, previous):
        known = known.unionByName(other.select("instance_type", "mem_mi"))
    return (
        known.filter(F.col("mem_mi") > 0)
        .groupBy("instance_type")
        .agg(F.min("mem_mi").alias("mem_mi"))
        .join(wanted, "instance_type", "left_semi")
    )


def volume_price(groups: DataFrame, prices: DataFrame) -> DataFrame:
    """Hourly volume price per node group.

    ``groups``: name, volume_type, volume_gb, iops, throughput (nullable), is_system.
    ``prices``: volume_type, price_gb, price_iops, price_throughput, monthly. io1 pays all its
    IOPS; gp3 pays what exceeds 3000 IOPS and 125 MiB/s. System groups default to 20 GB gp3.
    """
    system = F.coalesce("is_system", F.lit(False)) & F.col("volume_type").isNull()
    wanted = groups.withColumns(
        {
            "volume_type": F.when(system, "gp3").otherwise(F.col("volume_type")),
            "volume_gb": F.when(system, 20).otherwise(F.col("volume_gb")),
        }
    )
    joined = wanted.join(prices, "volume_type", "left")
    kind, iops, speed = F.col("volume_type"), F.col("iops"), F.col("throughput")
    io1 = F.when((kind == "io1") & iops.isNotNull(), F.col("price_iops") * iops)
    gp3 = F.when(
        (kind == "gp3") & iops.isNotNull() & speed.isNotNull(),
        F.col("price_iops") * F.greatest(iops - 3000, F.lit(0))
        + F.col("price_throughput") * F.greatest(speed - 125, F.lit(0)),
    )
    monthly = F.col("price_gb") * F.col("volume_gb") + F.coalesce(io1, gp3, F.lit(0.0))
    return joined.select(*groups.columns, (monthly / 30 / 24).alias("volume_price"))


SYSTEM_VOLUME_GB = 20
METRICS_VOLUME_GB = 40 + 2


def system_price(clusters: DataFrame, prices: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Itemised hourly price of each cluster's fixed parts, with a ``total`` row.

    ``clusters``: region, nat (none | single | highly_available), n_zones, n_operator,
    n_metrics, elb (API load balancer is a classic one). ``prices`` per region: eks, nlb, elb_price,
    nat_price, gp2_gb, gp3_gb, operator_node, metrics_node.
    """
    joined = clusters.join(prices, "region")
    hourly = 30 * 24
    nat = F.when(F.col("nat") == "single", F.col("nat_price")).when(
        F.col("nat") == "highly_available", F.col("nat_price") * F.col("n_zones")
    )
    system_volume = F.col("gp3_gb") * SYSTEM_VOLUME_GB / hourly
    items = {
        "control_plane": F.col("eks"),
        "metrics_volume": F.col("gp2_gb") * METRICS_VOLUME_GB / hourly,
        "load_balancers": F.when(F.col("elb"), F.col("nlb") + F.col("elb_price")).otherwise(2 * F.col("nlb")),
        "nat": F.coalesce(nat, F.lit(0.0)),
        "operator_nodes": F.col("n_operator") * (F.col("operator_node") + system_volume),
        "metrics_nodes": F.col("n_metrics") * (F.col("metrics_node") + system_volume),
    }
    rows = [F.struct(F.lit(n).alias("item"), c.cast("double").alias("price")) for n, c in items.items()]
    total = sum((c.cast("double") for c in list(items.values())[1:]), list(items.values())[0].cast("double"))
    rows.append(F.struct(F.lit("total").alias("item"), total.alias("price")))
    return joined.select("region", *keep, F.explode(F.array(*rows)).alias("r")).select(
        "region", *keep, "r.item", "r.price"
    )


def queue_depth(queues: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Visible, not visible and in-flight messages per queue; user messages leave out the placeholder."""
    return (
        queues.groupBy(*keys)
        .agg(F.sum("visible").alias("visible"), F.sum("not_visible").alias("not_visible"))
        .withColumn("in_flight", F.col("visible") + F.col("not_visible"))
        .withColumn("user_messages", F.greatest(F.col("in_flight") - 1, F.lit(0)))
    )
