"""What a plan did when it ran."""


def files_opened(df):
    """Files that each scan of a DataFrame reads, from its own counter, and whether its filter comes from a join."""
    df.collect()
    names, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            stack.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            stack.append(node.plan())
        elif "Scan parquet" in node.nodeName():
            metric = node.metrics().get("numFiles")
            names.append((metric.get().value(), "dynamicpruning" in node.simpleString(1000)))
        else:
            stack += [node.children().apply(i) for i in range(node.children().size())]
    return names
