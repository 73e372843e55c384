"""Sources and sinks: inventories, images, annotations, manifests, reports, results."""
