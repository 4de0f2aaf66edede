"""robots.txt as tables: rules by agent group, and which rule decides a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rules(robots: DataFrame) -> DataFrame:
    """(origin, agent, allow, pattern, delay) of (origin, status, text): consecutive agent lines form a group. Files that could not
    be read (status not 200, or no text) forbid everything."""
    readable = robots.where("status = 200 and text is not null")
    line = F.trim(F.regexp_replace(F.col("line"), r"#.*$", ""))
    x = readable.select("origin", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line", line).where("line rlike '^[A-Za-z-]+\\\\s*:'")
    x = x.select("origin", "pos", F.lower(F.trim(F.split("line", ":", 2)[0])).alias("field"), F.trim(F.split("line", ":", 2)[1]).alias("value"))
    w = Window.partitionBy("origin").orderBy("pos")
    x = x.withColumn("starts", ((F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")).cast("int"))
    x = x.withColumn("grp", F.sum("starts").over(w))
    agents = x.where("field = 'user-agent'").select("origin", "grp", F.lower("value").alias("agent"))
    delay = x.where("field = 'crawl-delay'").groupBy("origin", "grp").agg(F.max(F.col("value").try_cast("double")).alias("delay"))
    own = x.where("field in ('allow', 'disallow') and value <> ''").select("origin", "grp", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))
    out = agents.join(own, ["origin", "grp"], "left").join(delay, ["origin", "grp"], "left").select("origin", "agent", "allow", "pattern", "delay")
    closed = robots.where("not (status <=> 200) or text is null").select("origin", F.lit("*").alias("agent"), F.lit(False).alias("allow"), F.lit("/").alias("pattern"), F.lit(None).cast("double").alias("delay"))
    return out.unionByName(closed)


def decided(requests: DataFrame, rules_: DataFrame) -> DataFrame:
    """Adds ``allowed`` to (id, origin, path, agent): the group whose agent token is the longest part of the agent's name decides,
    else ``*``; in it the longest matching pattern, a tie going to allow; without a match the path is allowed."""
    groups = rules_.select("origin", F.col("agent").alias("token")).distinct()
    named = requests.join(groups, "origin", "left").withColumn("fits", F.when(F.col("token") == "*", 0).when(F.contains(F.lower("agent"), F.col("token")), F.length("token")))
    best = named.where("fits is not null").groupBy("id").agg(F.max_by("token", F.struct("fits", "token")).alias("token"))
    regex = F.regexp_replace(F.regexp_replace("pattern", r"([.?+^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), regex)  # a closing $ keeps its meaning
    x = requests.join(best, "id", "left").join(rules_.withColumnRenamed("agent", "token").withColumn("regex", regex), ["origin", "token"], "left")
    hit = x.where("regex is not null and path rlike regex").groupBy("id").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("allow"))
    return requests.join(hit, "id", "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")


def blanket(rules_: DataFrame) -> DataFrame:
    """(origin, agent) of the groups that forbid everything and allow nothing."""
    x = rules_.groupBy("origin", "agent").agg(F.coalesce(F.bool_or(~F.col("allow") & F.col("pattern").isin("/", "/*", "*")), F.lit(False)).alias("shut"), F.coalesce(F.bool_or("allow"), F.lit(False)).alias("opened"))
    return x.where("shut and not opened").select("origin", "agent")
