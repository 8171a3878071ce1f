"""The registered lineage queries; importing the package registers all of them."""

from weftline.plans import catalog, declarations, documents, endpoints, resolutions, scalars, states, structures, traversals  # noqa: F401
